"""A feed of a table that fails in one way or another."""
from loam.sources import paged


def down(request, options):
    if request["start"] > options["since"]:
        raise OSError("down")
    return paged.from_table(request, options)


def cut(request, options):
    page = paged.from_table(request, options)
    return page | {"rows": page["rows"][:3] if request["offset"] < 6 else []}
