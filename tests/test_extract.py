"""Nodes and edges of enriched records."""
from loam.operators import extract

SCHEMA = ", ".join(f"`{k}` {v}" for k, v in extract.RECORD.items())


def record(**values):
    return tuple(values.get(k) for k in extract.RECORD)


def match(vendor, product, start=None, end=None):
    return (vendor, product, start, None, None, end)


def extracted(spark, *records):
    nodes, edges = extract.graph(spark.createDataFrame(list(records), SCHEMA))
    return {(r.label, r.key): r.properties for r in nodes.collect()}, {(r.relation, r.start_key, r.end_key): r.properties for r in edges.collect()}


def test_every_kind_with_its_properties(spark):
    nodes, edges = extracted(spark, record(
        vuln_id="CVE-1", title="Flaw in PAN-OS", description="d" * 700, severity="HIGH", kev=True, risk_score=81.5, sources=["nvd"], aliases=[], cwe_ids=["CWE-78"], cpe_matches=[match("paloalto", "pan-os", "10.2.0", "10.2.9")], ecosystem_packages=["PyPI:pan-os", ":", "alone"],
        affected_assets=[("fw", "product", "Palo Alto", None, None, 0.9), ("fw", "product", "x", None, None, 0.1), ("gw", "host", None, None, None, None)], related_papers=[("2401.1", "method", 0.7, ["t1"]), (None, "x", 0.1, [])],
        attack_steps=[(1, " t1190 ", "initial-access", "s", "d", ["net"]), (2, " ", None, None, None, None)], references=[("https://x/patches/1", "nvd", []), ("https://x/y", "nvd", [" Patch "]), ("https://x/z", "nvd", ["misc"]), ("", "nvd", ["patch"])]))
    assert set(nodes) == {("Vulnerability", "CVE-1"), ("Component", "paloalto:pan-os"), ("Component", "PyPI:pan-os"), ("Asset", "product:fw"), ("Asset", "host:gw"), ("Paper", "2401.1"), ("AttackTechnique", "T1190"), ("Patch", "https://x/patches/1"), ("Patch", "https://x/y")}
    v = nodes["Vulnerability", "CVE-1"]
    assert v["cve_id"] == "CVE-1" and v["kev"] == "true" and v["sources"] == '["nvd"]' and len(v["description"]) == 600 and "aliases" not in v and "epss_score" not in v
    assert nodes["Component", "paloalto:pan-os"] == {"key": "paloalto:pan-os", "name": "pan-os", "vendor": "paloalto", "version_range": ">=10.2.0, <10.2.9", "vulnerable": "true", "confidence": "1.0", "relevance": "text", "effective_confidence": "1.0"}
    assert nodes["Component", "PyPI:pan-os"]["ecosystem"] == "PyPI" and nodes["Component", "PyPI:pan-os"]["confidence"] == "0.5"
    assert nodes["Asset", "product:fw"]["vendor"] == "Palo Alto" and nodes["AttackTechnique", "T1190"]["order"] == "1"
    assert edges["AFFECTS", "CVE-1", "paloalto:pan-os"] == {"version_range": ">=10.2.0, <10.2.9"} and edges["AFFECTS", "CVE-1", "PyPI:pan-os"] == {}
    assert edges["INSTALLED_ON", "paloalto:pan-os", "product:fw"] == {"derived_from": "cve-cooccurrence", "confidence": "0.9"} and edges["INSTALLED_ON", "PyPI:pan-os", "host:gw"] == {"derived_from": "cve-cooccurrence"}
    assert edges["RELATED_TO", "CVE-1", "2401.1"] == {"relation": "method", "confidence": "0.7", "evidence_refs": '["t1"]'}
    assert edges["EXPLOITS", "CVE-1", "T1190"] == {"order": "1", "tactic": "initial-access", "stage": "s", "preconditions": '["net"]'}
    assert edges["FIXED_BY", "CVE-1", "https://x/y"] == {"tags": '[" Patch "]', "source": "nvd"} and len(edges) == 10


def test_components_by_relevance(spark):
    many = [match("apple", "xcode"), match("apache", "log4j2"), match("acme", "shell"), *(match("z", f"p{i}") for i in range(9))]
    nodes, edges = extracted(spark, record(vuln_id="A", title="Log4j remote code", cwe_ids=["cwe-78 "], cpe_matches=many))
    assert {k for label, k in nodes if label == "Component"} == {"apache:log4j2", "acme:shell"}
    assert nodes["Component", "apache:log4j2"]["relevance"] == "text" and nodes["Component", "acme:shell"]["relevance"] == "cwe"
    # nothing related: the first five by an asset's vendor, then by key, at half confidence
    nodes, _ = extracted(spark, record(vuln_id="B", title="the user", cpe_matches=many, affected_assets=[("a", "t", " Z inc", None, None, 0.5)]))
    assert {k for label, k in nodes if label == "Component"} == {f"z:p{i}" for i in range(5)} and {p["effective_confidence"] for (label, _), p in nodes.items() if label == "Component"} == {"0.5"}


def test_shared_nodes_and_empty_records(spark):
    nodes, edges = extracted(spark, record(vuln_id="B", cpe_matches=[match("v", "p", None, "2")]), record(vuln_id="A", cpe_matches=[match("v", "p", None, "1"), match("v", "p", None, "3")]), record(vuln_id="C"), record())
    assert set(nodes) == {("Vulnerability", "A"), ("Vulnerability", "B"), ("Vulnerability", "C"), ("Component", "v:p")}
    assert nodes["Component", "v:p"]["version_range"] == "<1" and edges["AFFECTS", "B", "v:p"] == {"version_range": "<2"} and len(edges) == 2
