"""Folds over ordered rows against plain loops: positions, groups under a budget, leaders, merges, at sizes of blocks that divide the keys."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import findings, ordered
from millrace.schema import CONFIDENCE_RANK, SEVERITY_RANK


def test_positions(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, "a", "b"]), i, rng.random()) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i int, x double").repartition(7)
    out, _ = ordered.positions(df, ["k"], ["x", "i"])
    want = {}
    for k in (None, "a", "b"):
        want |= {r[1]: n for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (r[2], r[1])), 1)}
    assert {r.i: r.position for r in out.collect()} == want
    assert ordered.positions(df.limit(0), ["k"], ["x"])[0].count() == 0


def groups(rows, most):
    out, now, same, size, n = {}, None, None, 0, 0
    for k, i, s, z in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        if k != now:
            now, n = k, 0
        z = z or 0
        if n == 0 or s != same or size + z > most:
            n, size = n + 1, 0
        same, size = s, size + z
        out[k, i] = n
    return out


@pytest.mark.parametrize("block", [1, 3, 16, 20_000])
@pytest.mark.parametrize("most", [0, 7, 40])
def test_groups_at_any_block(spark, block, most):
    rng = random.Random(block * 100 + most)
    rows = [(k, i, rng.choice([None, "s", "s", "s", "t"]) if k == "mixed" else "s", rng.choice([0, 0, 1, 3, 5, 9, 50 if k == "mixed" else 2, None])) for k in ("hot", "mixed", None) for i in range(150 if k == "hot" else 60)]
    df = spark.createDataFrame(rows, "k string, i int, s string, z int").repartition(3)
    out = ordered.greedy_groups(df, ["k"], ["i"], F.col("s"), F.col("z"), most, block)
    assert {(r.k, r.i): r.group_no for r in out.collect()} == groups(rows, most)


def test_groups_of_a_hot_key(spark):
    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") % 7).alias("z"))
    out = ordered.greedy_groups(df, ["k"], ["id"], F.lit("s"), F.col("z"), 20, 5000)
    # Sizes repeat every seven rows with a sum of 21, so the groups of the plain loop repeat too.
    want, size, g = [], 0, 1
    for i in range(n):
        if size + i % 7 > 20:
            g, size = g + 1, 0
        size += i % 7
        want.append(g)
    last = out.agg(F.max("group_no"), F.count(F.lit(1)), F.sum(F.col("group_no") * (F.col("id") + 1))).first()
    assert tuple(last) == (g, n, sum(w * (i + 1) for i, w in enumerate(want)))


FIELDS = "k int, i int, file string, category string, fingerprint string, line_number int, end_line int, tokens array<string>"


def first_leaders(rows):
    def last(r):
        return r[6] or r[5]

    def same(a, b):
        if a[4] is not None and a[4] == b[4]:
            return True
        if a[2] is None or a[2] != b[2]:
            return False
        x, y = set(a[7]), set(b[7])
        if (len(x & y) / len(x | y) if x | y else 1.0) >= 0.72:
            return True
        return a[3] is not None and a[3] == b[3] and None not in (a[5], b[5]) and a[5] - 5 <= last(b) + 5 and b[5] - 5 <= last(a) + 5

    out, own = {}, {}
    for k in {r[0] for r in rows}:
        leaders = []
        for n, r in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: r[1]), 1):
            found = next((p for p, a in leaders if same(a, r)), None)
            out[k, r[1]] = (n, found or n)
            leaders += [] if found else [(n, r)]
        own[k] = len(leaders)
    return out


@pytest.mark.parametrize(("prefix", "block"), [(1, 3), (4, 10), (2000, 20_000)])
def test_leaders_at_any_prefix(spark, prefix, block):
    rng = random.Random(prefix)
    words = ["sql", "injection", "weak", "hash", "open", "file", "path", "unsafe"]
    rows = [
        (k, i, rng.choice(["a", "a", "b", None]), rng.choice(["x", "y", None]), rng.choice([None, f"p{rng.randrange(60)}"]), rng.choice([None, rng.randrange(900)]), None, rng.sample(words, rng.choice([0, 2, 3, 4])))
        for k in (1, 2) for i in range(90 if k == 1 else 12)
    ]
    rows = [(*r[:6], r[5] + rng.choice([0, 1, 30]) if r[5] and rng.random() < 0.5 else rng.choice([None, 0]), r[7]) for r in rows]
    df = spark.createDataFrame(rows, FIELDS).repartition(3)
    last = F.coalesce(F.nullif(F.col("end_line"), F.lit(0)), F.col("line_number"))
    out = ordered.leaders(df.withColumn("_last_line", last), ["k"], ["i"], findings.SAME, prefix, block)
    assert {(r.k, r.i): (r.position, r.leader) for r in out.collect()} == first_leaders(rows)


def test_leaders_of_a_hot_key(spark):
    """One file of many findings at distinct lines: leaders stand eleven lines apart, as the plain loop would have them."""
    n = 60_000
    df = spark.range(n).select(F.lit(1).alias("k"), "id", (F.col("id") % 30_000).cast("int").alias("line"))
    out = ordered.leaders(df, ["k"], ["id"], (ordered.Rule(("k",), near=("line", "line", 10)),), 3000, 4000)
    assert out.where("leader <> 1 + line - line % 11").isEmpty() and out.count() == n


def absorbed(records):
    """The reference fold of one group's records, in order."""
    p = {c: (list(v) if isinstance(v, list) else v) for c, v in records[0].items()}
    for a in records[1:]:
        p["source_tools"] = list(dict.fromkeys(p["source_tools"] + a["source_tools"]))
        if SEVERITY_RANK.get(a["severity"], 0) > SEVERITY_RANK.get(p["severity"], 0):
            p["merge_notes"].append(f"Severity elevated from {p['severity']} → {a['severity']} by {a['primary_tool']}.")
            p["severity"], p["reported_severity"] = a["severity"], a["reported_severity"]
        if CONFIDENCE_RANK.get(a["confidence"], 0) > CONFIDENCE_RANK.get(p["confidence"], 0):
            p["confidence"], p["reported_confidence"], p["primary_tool"] = a["confidence"], a["reported_confidence"], a["primary_tool"]
        p["cwe_id"] = p["cwe_id"] or a["cwe_id"] or p["cwe_id"]
        if a["reasoning"] and a["reasoning"] not in p["reasoning"]:
            p["reasoning"] = p["reasoning"] + f"\n\n[{a['primary_tool']}] {a['reasoning']}" if p["reasoning"] else a["reasoning"]
        if len(a["suggested_remediation"]) > len(p["suggested_remediation"]):
            p["suggested_remediation"] = a["suggested_remediation"]
        p["merge_notes"].append(f"Absorbed duplicate from {a['primary_tool']} (similarity/overlap detected).")
        p["duplicate_count"] += 1
    return p


def test_merge_equals_the_fold(spark):
    from millrace.schema import FINDING_DDL

    rng, rows = random.Random(4), []
    for k in range(12):
        for position in range(1, rng.choice([2, 3, 9, 40])):
            tool = rng.choice(["bandit", "scan", "logic"])
            level = lambda: rng.choice(["critical", "high", "medium", "low", "info", "odd"])
            rows.append({
                "title": f"t{position}", "description": "d", "category": "c", "reported_severity": level(), "reported_confidence": "x", "severity": level(), "confidence": rng.choice(["high", "medium", "low", "?"]),
                "file": "f", "line_number": position, "end_line": None, "affected_code": "", "reasoning": rng.choice(["", "a", "ab", "b", "abc", "z y"]), "suggested_remediation": "x" * rng.randrange(4) + rng.choice("pq"), "source_tools": [tool] if rng.random() < 0.8 else [tool, "more"],
                "primary_tool": tool, "cwe_id": rng.choice([None, "", "CWE-1", "CWE-2"]), "test_id": "", "more_info": "", "fingerprint": "", "merge_notes": ["was"] if rng.random() < 0.2 else [], "duplicate_count": 1, "k": k, "position": position, "leader": 1, "extra": position,
            })
    df = spark.createDataFrame([tuple(r.values()) for r in rows], f"{FINDING_DDL}, k int, position long, leader long, extra int").repartition(5)
    got = {r["k"]: r.asDict() for r in findings.merge(df, ["k"], ("extra",)).collect()}
    for k in range(12):
        want = absorbed([r for r in rows if r["k"] == k])
        assert {c: got[k][c] for c in want if c != "position"} == {c: v for c, v in want.items() if c != "position"}, k
