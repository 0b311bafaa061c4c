"""Attack chains: the offline mapping from weaknesses, and normalizers of free text."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weakness, technique, tactic and stage.
BY_WEAKNESS = [
    ("CWE-22", "T1190", "initial-access", "Exploitation"), ("CWE-77", "T1059", "execution", "Exploitation"),
    ("CWE-78", "T1059", "execution", "Exploitation"), ("CWE-79", "T1059.007", "execution", "Exploitation"), ("CWE-89", "T1190", "initial-access", "Exploitation"),
    ("CWE-94", "T1059", "execution", "Exploitation"), ("CWE-119", "T1203", "execution", "Exploitation"), ("CWE-120", "T1203", "execution", "Exploitation"),
    ("CWE-125", "T1005", "collection", "Exploitation"), ("CWE-190", "T1203", "execution", "Exploitation"), ("CWE-287", "T1078", "initial-access", "Exploitation"),
    ("CWE-306", "T1078", "initial-access", "Exploitation"), ("CWE-352", "T1190", "initial-access", "Exploitation"), ("CWE-400", "T1499", "impact", "Actions-on-Objective"),
    ("CWE-502", "T1190", "initial-access", "Exploitation"), ("CWE-798", "T1078.004", "initial-access", "Exploitation"), ("CWE-918", "T1090", "command-and-control", "Exploitation"),
    ("CWE-1321", "T1190", "initial-access", "Exploitation"), ("CWE-1426", "T1195", "initial-access", "Delivery"),
]
#: Tactics of the public enterprise matrix.
TACTICS = ["collection", "command-and-control", "credential-access", "defense-evasion", "discovery", "execution", "exfiltration", "impact", "initial-access", "lateral-movement", "persistence", "privilege-escalation", "reconnaissance", "resource-development"]
#: Words that tell needed privileges, in order of priority.
PRIVILEGES = [("none", ["none", "unauth", "unauthenticated", "无需", "未认证", "无", "未授权"]), ("low", ["low", "低权", "普通用户", "user"]), ("high", ["high", "admin", "root", "管理员", "高权", "system"])]
MAX_STEPS = 6
STEP = "struct<step:int,technique_id:string,tactic:string,stage:string>"


def fallback_chain(weaknesses: Column) -> Column:
    """(step, technique_id, tactic, stage) for the known weaknesses, in their order; null if none is known."""
    table = F.create_map(*(x for w, t, tactic, stage in BY_WEAKNESS for x in (F.lit(w), F.struct(F.lit(t).alias("technique_id"), F.lit(tactic).alias("tactic"), F.lit(stage).alias("stage")))))
    found = F.filter(F.transform(weaknesses, lambda w: F.try_element_at(table, F.upper(F.trim(w)))), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, renumber(found))


def renumber(steps: Column) -> Column:
    return F.transform(steps, lambda x, i: F.struct((i + 1).cast("int").alias("step"), x["technique_id"].alias("technique_id"), x["tactic"].alias("tactic"), x["stage"].alias("stage")))


def tactic(c: Column) -> Column:
    """Lower case with hyphens, whatever stood between the words."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[_\s-]+", " ")), " ", "-")


def sanitize_chain(steps: Column, most: int = MAX_STEPS) -> Column:
    """The first valid steps (a technique id and a known tactic), numbered anew."""
    technique = lambda x: F.upper(F.trim(x["technique_id"]))
    good = F.filter(steps, lambda x: F.regexp_like(technique(x), F.lit(r"^T[0-9]{4}(\.[0-9]{3})?$")) & F.lower(F.trim(x["tactic"])).isin(*TACTICS))
    clean = F.transform(F.slice(good, 1, most), lambda x: F.struct(technique(x).alias("technique_id"), F.lower(F.trim(x["tactic"])).alias("tactic"), x["stage"].alias("stage")))
    return renumber(clean)


def privileges(c: Column) -> Column:
    low = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = F
    for level, words in PRIVILEGES:
        out = out.when(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words)), level)
    return out.otherwise("unknown")


def preconditions(c: Column) -> Column:
    """Parts between semicolons and line ends, without blanks at their ends; empty ones go."""
    return F.filter(F.transform(F.split(c, "[;\\n；]"), lambda x: F.trim(x)), lambda x: x != "")


def needs_smart_model(kev: Column, level: Column, gate: bool = True) -> Column:
    return F.coalesce(kev, F.lit(False)) | F.coalesce(F.lower(level).isin("high", "critical"), F.lit(False)) if gate else F.lit(True)
