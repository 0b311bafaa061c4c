"""Text expressions: cleaning, tokens, identifiers, HTML and prompt-injection rules. Column in, Column out."""
from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .cvss import let

#: Identifier patterns.
CVE = r"\bCVE-\d{4}-\d{4,}\b"
ALIASES = [r"\bGHSA(?:-[23456789cfghjmpqrvwx]{4}){3}\b", r"\bPYSEC-\d{4}-\d+\b", r"\bOSV-\d{4}-\d+\b", r"\bCNVD-\d{4}-\d+\b", r"\bCWE-\d+\b"]
#: Block tags that go with their content.
BLOCK_TAGS = ["embed", "iframe", "noscript", "object", "script", "style", "svg", "template"]
#: Marks of chat templates and roles, zero-width and control characters.
CHAT_TEMPLATE = r"(?i)<\|(?:im_start|im_end|system|user|assistant|endoftext|start_header_id|end_header_id|begin_of_text)(?:\|[^>]*)?\|>|\[/?INST\]|<<\s*/?SYS\s*>>|</?s>"
ROLE_LINE = r"(?im)^[ \t]*(?:#{2,4}[ \t]*)?(?:system|assistant|developer|系统|助手)[ \t]*[:：]"
ROLE_HEADER = r"(?im)^[ \t]*#{2,4}[ \t]*(?:system|instruction|override)\b"
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{2060}-\x{2064}\x{feff}\x{202a}-\x{202e}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
#: Injection rules, name and pattern.
INJECTION = [
    ("instruction_override_en", r"(?i)\b(?:ignore|disregard|forget|skip|override|bypass)\b[^.\n]{0,40}\b(?:previous|prior|above|earlier|all|any)\b[^.\n]{0,24}\b(?:instruction|prompt|rule|direction|message|constraint)s?\b"),
    ("instruction_override_zh", r"(?:忽略|无视|忘记|跳过|覆盖|摆脱)[^。\n]{0,24}(?:以上|之前|先前|上面|所有|全部|任何)?[^。\n]{0,12}(?:指令|提示|规则|要求|设定|限制)"),
    ("new_instructions", r"(?i)\bnew\s+(?:instructions?|rules?|task)\s*[:：]|\bupdated\s+instructions?\b|(?:新的|以下是新的|重新设定)(?:指令|规则|任务)"),
    ("chat_template_token", CHAT_TEMPLATE),
    ("llama_inst_tag", r"(?i)\[/?INST\]|<<\s*/?SYS\s*>>"),
    ("role_line_marker", ROLE_LINE),
    ("role_header_markdown", ROLE_HEADER),
    ("prompt_boundary_spoof", r"(?im)^[ \t]*(?:end|beginning|start)\s+of\s+(?:system|user|assistant)\s+(?:prompt|message|input|turn)"),
    ("persona_jailbreak", r"(?i)\b(?:dan\s*mode|do anything now|jailbreak|developer mode|unrestricted mode|no restrictions|no filters)\b"),
    ("jailbreak_zh", r"(?:越狱|开发者模式|无限制模式|不受(?:任何)?限制|解除(?:所有)?限制|跳出(?:你的)?限制)"),
    ("you_are_now", r"(?i)\b(?:you are now|from now on[, ]+you (?:are|will|must)|act as if you (?:are|were)|pretend (?:that )?you(?:'re| are))\b"),
    ("role_play_hijack", r"(?i)\b(?:pretend|imagine|simulate)\b[^.\n]{0,20}\b(?:you|to be)\b"),
    ("prompt_leak_en", r"(?i)\b(?:reveal|show|print|repeat|echo|dump|disclose|tell me)\b[^.\n]{0,30}\b(?:system prompt|system message|initial instruction|your instructions?|the prompt above|words above|everything above)\b"),
    ("prompt_leak_zh", r"(?:泄露|透露|输出|展示|打印|重复|复述)[^。\n]{0,12}(?:系统提示词|系统提示|系统指令|初始指令|上面的指令|之前的指令)"),
    ("repeat_words_above", r"(?i)\b(?:repeat|echo|copy)\b[^.\n]{0,20}\b(?:the\s+)?(?:words|text|content|everything|prompt)\b[^.\n]{0,20}\babove\b"),
    ("bypass_safety", r"(?i)\b(?:bypass|disable|turn off|evade|ignore)\b[^.\n]{0,25}\b(?:safety|guardrail|guard rails?|filter|filtering|restriction|policy|moderation|alignment)\b"),
    ("bypass_safety_zh", r"(?:绕过|关闭|禁用|无视)[^。\n]{0,12}(?:审查|安全|过滤|限制|策略|风控)"),
    ("unfiltered_output", r"(?i)\b(?:respond|answer|reply|write)\b[^.\n]{0,20}\b(?:without|ignoring|regardless of)\b[^.\n]{0,20}\b(?:restriction|filter|policy|ethic|rule)s?\b"),
    ("do_not_mention", r"(?i)\b(?:do not|don't)\b[^.\n]{0,15}\b(?:mention|tell|reveal|disclose)\b[^.\n]{0,25}\b(?:instruction|prompt|rule|user)s?\b|(?:不要|不得)(?:提及|告诉|透露)[^。\n]{0,15}(?:指令|提示|用户)"),
    ("encoding_evasion", r"(?i)\b(?:base64|rot13|hex(?:adecimal)?|base32|url[- ]?encoded?)\b[^.\n]{0,30}\b(?:decode|decoding|解码)\b[^.\n]{0,30}\b(?:then|and|并|然后)\b[^.\n]{0,20}\b(?:run|execute|follow|obey|执行|运行|遵守)\b"),
    ("template_variable_smuggling", r"\{\{[^}]{0,30}(?:system|prompt|instruction)[^}]{0,30}\}\}|\$\{[^}]{0,30}(?:system|prompt|instruction)[^}]{0,30}\}"),
    ("json_field_injection", r"""["'](?:tool_calls?|function_call|system_prompt|role)["']\s*:"""),
    ("zero_width_obfuscation", ZERO_WIDTH),
    ("shell_payload", r"(?i)\brm\s+-rf\b|\bcurl\b[^|\n]{0,80}\|\s*(?:ba|z|k)?sh\b|\bsubprocess\.(?:run|call|Popen)\b|\bos\.system\s*\("),
    ("sql_payload", r"(?i)\b(?:drop\s+table|truncate\s+table|delete\s+from|insert\s+into|update\s+\w+\s+set)\b"),
    ("cypher_payload", r"(?i)\b(?:detach\s+delete|drop\s+constraint|create\s+\(|merge\s+\()"),
    ("tool_abuse", r"(?i)\b(?:call|invoke|execute|use)\b[^.\n]{0,20}\b(?:the\s+)?(?:tool|function)\b[^.\n]{0,30}\b(?:delete|drop|truncate|exfiltrate|leak|write)\b"),
    ("delimiter_override", r"(?m)^[ \t]*(?:-{3,}|={3,}|<{3,}|>{3,})[ \t]*(?:end|begin|new|system|user|context|输入结束|系统提示)"),
]
#: Of each rule, parts of which every match has one, in lower case. Finding them costs a small part of a match.
_PART_OF = {
    "instruction_override_en": ["instruction", "prompt", "rule", "direction", "message", "constraint"], "instruction_override_zh": ["指令", "提示", "规则", "要求", "设定", "限制"], "new_instructions": ["instruction", "rule", "task", "指令", "规则", "任务"],
    "chat_template_token": ["<|", "inst]", "<<", "s>"], "llama_inst_tag": ["inst]", "<<"], "role_line_marker": ["system", "assistant", "developer", "系统", "助手"], "role_header_markdown": ["##"], "prompt_boundary_spoof": ["system", "user", "assistant"],
    "persona_jailbreak": ["mode", "anything now", "jailbreak", "no restrictions", "no filters"], "jailbreak_zh": ["越狱", "开发者模式", "限制"], "you_are_now": ["you are now", "from now on", "act as if you", "pretend"], "role_play_hijack": ["pretend", "imagine", "simulate"],
    "prompt_leak_en": ["system prompt", "system message", "initial instruction", "your instruction", "the prompt above", "words above", "everything above"], "prompt_leak_zh": ["系统提示", "系统指令", "初始指令", "上面的指令", "之前的指令"], "repeat_words_above": ["above"],
    "bypass_safety": ["bypass", "disable", "turn off", "evade", "ignore"], "bypass_safety_zh": ["绕过", "关闭", "禁用", "无视"], "unfiltered_output": ["without", "ignoring", "regardless of"], "do_not_mention": ["do not", "don't", "不要", "不得"], "encoding_evasion": ["decod", "解码"],
    "template_variable_smuggling": ["{{", "${"], "json_field_injection": ["tool_call", "function_call", "system_prompt", "role"], "shell_payload": ["-rf", "curl", "subprocess", "os.system"], "sql_payload": ["table", "delete", "insert", "update"],
    "cypher_payload": ["detach", "constraint", "create", "merge"], "tool_abuse": ["tool", "function"], "delimiter_override": ["---", "===", "<<<", ">>>"],
}


def _rx(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def clean_text(c: Column) -> Column:
    """Tags become blanks, white space collapses, ends are trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, in order."""
    return _rx(F.lower(F.coalesce(c, F.lit(""))), "[a-z0-9]+")


def hash_tokens(c: Column) -> Column:
    """ASCII tokens longer than one, then each run of CJK characters as bigrams (a single character as itself)."""
    low = F.lower(F.coalesce(c, F.lit("")))
    ascii_ = F.filter(_rx(low, "[a-z0-9]+"), lambda t: F.length(t) > 1)
    runs = _rx(low, "[\\u4e00-\\u9fff]+")
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.concat(ascii_, pairs)


def query_keywords(c: Column) -> Column:
    return F.array_distinct(hash_tokens(c))


def _joined(texts: tuple[Column, ...]) -> Column:
    """The texts, a line feed between two, which is part of no identifier and ends each."""
    return F.concat_ws("\n", *texts)


def cve_ids(*texts: Column) -> Column:
    """Identifiers of all texts, upper case, first seen first."""
    return F.array_distinct(F.transform(_rx(_joined(texts), f"(?i)(?=C){CVE}"), F.upper))


def aliases(*texts: Column) -> Column:
    """Aliases by pattern, then by text. No two patterns can overlap or match at one place, so the texts are read once for all, where a first letter stands; a match's first letters tell its pattern."""
    found = _rx(_joined(texts), f"(?i)(?=[CGOP])(?:{'|'.join(ALIASES)})")
    of = lambda c, pattern: F.filter(c, lambda x: F.startswith(F.upper(x), F.lit(re.match(r"\\b([A-Z]+)", pattern)[1])))
    return let(found, lambda c: F.when(F.size(c) < 2, c).otherwise(F.array_distinct(F.concat(*(of(c, p) for p in ALIASES)))))


def is_cve(c: Column) -> Column:
    return F.regexp_like(F.upper(F.trim(c)), F.lit(f"^{CVE}$"))


def vuln_key(c: Column, source: Column | str = "", most: int = 32) -> Column:
    """CVE ids in upper case; identifiers without blanks, colons and slashes that are short enough as they are; else PREFIX-slug-ten digits of the hash, where the slug comes from a link's path."""
    c = F.trim(c)
    squeeze = lambda x, by: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[^A-Za-z0-9]+", by), f"{by}{{2,}}", by), f"^{by}+|{by}+$", "")
    prefix = F.nullif(squeeze(F.upper(F.trim(F.lit(source) if isinstance(source, str) else source)), "_"), F.lit(""))
    prefix = F.coalesce(prefix, F.lit("SRC"))
    path = F.regexp_replace(F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1), "/+$", "")
    slug = squeeze(F.when(path != "", path).otherwise(c), "-")
    digest = F.upper(F.substring(F.sha2(c, 256), 1, 10))
    room = F.greatest(F.lit(1), F.lit(most) - F.length(prefix) - 12)
    head = F.regexp_replace(F.substring(slug, F.lit(1), room), "^-+|-+$", "")
    folded = F.substring(F.concat_ws("-", prefix, head, digest), 1, most)
    return F.when(c.isNull() | (c == ""), F.lit(None).cast("string")).when(is_cve(c), F.upper(c)).when((F.length(c) <= most) & ~F.regexp_like(c, F.lit(r"[:/? ]")), c).otherwise(folded)


def html_text(c: Column, most: int = 2000) -> Column:
    """Visible text: blocks go with their content, tags become blanks, common entities are read, white space collapses, and the end is cut."""
    for tag in BLOCK_TAGS:
        c = F.regexp_replace(c, f"(?is)<{tag}\\b.*?</{tag}>", " ")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, most)


def strip_controls(c: Column) -> Column:
    """Without zero-width and control characters, but for tab, line feed and carriage return."""
    return F.regexp_replace(F.regexp_replace(c, ZERO_WIDTH, ""), CONTROL, "")


def strip_chat_markup(c: Column) -> Column:
    """Marks of chat templates, role lines and role headers become blanks."""
    for pattern in (CHAT_TEMPLATE, ROLE_LINE, ROLE_HEADER):
        c = F.regexp_replace(c, pattern, " ")
    return c


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode compatibility composition, for which Spark has no function. Only texts beyond ASCII are worked on."""
    return texts.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def normalize_prompt(c: Column, most: int | None = None) -> Column:
    """Compatibility form without hidden characters; runs of blanks become one, of line feeds two; ends are trimmed and the rest cut at `most`."""
    c = strip_controls(nfkc(F.coalesce(c, F.lit(""))))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t\x{3000}]{2,}", " "), r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.substring(c, 1, most) if most else c


def injection_flags(c: Column) -> Column:
    """Names of the rules that match the text or the text without chat marks, in the rules' order. A rule is tried where a part stands that its matches have."""
    def hits(x: Column) -> Column:
        may = lambda low, name: reduce(or_, (F.contains(low, F.lit(part)) for part in _PART_OF[name])) if name in _PART_OF else F.lit(True)
        return let(F.lower(x), lambda low: F.filter(F.array(*(F.when(may(low, n) & F.regexp_like(x, F.lit(p)), F.lit(n)) for n, p in INJECTION)), lambda y: y.isNotNull()))

    def of(x: Column) -> Column:
        # few texts have chat marks; the others are matched once
        order = F.array(*(F.lit(n) for n, _ in INJECTION))
        return F.when(x["c"] == x["bare"], hits(x["c"])).otherwise(F.array_intersect(order, F.array_union(hits(x["c"]), hits(x["bare"]))))
    return let(F.struct(c.alias("c"), strip_chat_markup(c).alias("bare")), of)


#: Rules of medium severity; all others are high. And how long a question may be.
MEDIUM = ["you_are_now", "role_play_hijack", "unfiltered_output", "do_not_mention", "encoding_evasion", "template_variable_smuggling", "json_field_injection", "sql_payload", "cypher_payload", "delimiter_override"]
MOST_QUERY_CHARS = 500


def guard(c: Column, most: int = MOST_QUERY_CHARS, strict: bool = True) -> Column:
    """(allowed, text, flags, severity, truncated) of a question: its normal form without chat marks, cut at `most`, the rules that the question or that form match, the highest severity among them, and whether it was cut.
    It is allowed if something is left and no rule of high severity matches, nor one of medium severity if strict."""
    def verdict(whole: Column, clean: Column, flags: Column) -> Column:
        high = F.size(F.array_except(flags, F.array(*map(F.lit, MEDIUM)))) > 0
        severity = F.when(high, "high").when(F.size(flags) > 0, "medium")
        blocked = severity.isNotNull() if strict else high
        return F.struct(((F.trim(F.regexp_replace(clean, r"\s+", " ")) != "") & ~blocked).alias("allowed"), clean.alias("text"), flags.alias("flags"), severity.alias("severity"), (F.length(whole) > most).alias("truncated"))

    def checked(raw: Column, whole: Column, clean: Column) -> Column:
        order = F.array(*(F.lit(n) for n, _ in INJECTION))
        # a text that is in its normal form is matched once
        flags = F.when(raw == clean, injection_flags(raw)).otherwise(F.array_intersect(order, F.array_union(injection_flags(raw), injection_flags(clean))))
        return let(flags, lambda f: verdict(whole, clean, f))
    forms = F.struct(F.coalesce(c, F.lit("")).alias("raw"), normalize_prompt(c).alias("whole"))
    return let(forms, lambda x: let(strip_chat_markup(F.substring(x["whole"], 1, most)), lambda clean: checked(x["raw"], x["whole"], clean)))


def fulltext_score(text: Column, keywords: list[str]) -> Column:
    """Share of keywords that are part of some token, in ten-thousandths. Tokens are runs of a-z and 0-9, so a keyword of these is part of one where it is part of the text; no other keyword is."""
    low = F.lower(text)
    part_of = lambda k: F.contains(low, F.lit(k)) if re.fullmatch("[a-z0-9]+", k) else F.lit(False)
    hits = sum((F.when(part_of(k), 1).otherwise(0) for k in keywords), F.lit(0))
    return F.floor(hits * 10000 / len(keywords) + 0.5).cast("long")


def graph_tokens(c: Column, generic: list[str]) -> Column:
    """Tokens of two characters or more that are neither generic nor numbers, once each; then trailing digits go where three characters stay."""
    # a run of two characters or more is found whole; the generic words are a set that is made once
    parts = F.filter(_rx(F.lower(c), "[0-9a-z\\u4e00-\\u9fa5]{2,}"), lambda t: ~t.isin(*generic) & ~F.regexp_like(t, F.lit("^[0-9]+$")))
    return F.array_distinct(F.transform(parts, lambda t: F.regexp_replace(t, "^(.{2,}[^0-9])[0-9]+$", "$1")))


def ascii_lang(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(r"^[\x00-\x7F]*$")), F.lit("en"))
