import json


def fetch(start, end):
    return [json.dumps({"start": start, "end": end})]
