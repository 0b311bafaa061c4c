"""A feed of many pages that writes down what it is asked for."""
import json
import os

ROWS = [(f"id{i:03}", f"2024-{1 + i % 9:02}-{1 + i % 28:02}T0{i % 10}:00:00", json.dumps({"n": i})) for i in range(250)]


def asked(options, request):
    with open(os.path.join(options["log"], f"{os.getpid()}"), "a") as f:
        f.write(json.dumps(request) + "\n")


def index_pages(request, options):
    asked(options, request)
    if "ids" in request:
        return {"rows": [r for r in ROWS if r[0] in request["ids"]] + ROWS[:1]}
    if request["query"] == "broken":
        raise OSError("down")
    rows = [r for r in ROWS if request["start"] <= r[1][:10] < request["end"] and (request["query"] in (None, "all") or int(r[0][2:]) % 2 == 0)]
    return {"rows": rows[request["offset"]:request["offset"] + request["size"]], "total": len(rows)}


def cursor_pages(request, options):
    asked(options, request)
    rows = sorted(ROWS, key=lambda r: r[1], reverse=True)
    at = int(request["cursor"] or 0)
    return {"rows": rows[at:at + request["size"]], "next": str(at + request["size"]) if at + request["size"] < len(rows) else None}
