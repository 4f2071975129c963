"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings. DataFrame functions only.

Base kinds are matched leftmost and without overlap. A candidate is a run of 20 or more key characters with a digit and a
letter. A window of 20 characters moves over it; its counts by character, and the sum of c * log2(c) that gives the Shannon
entropy, change by one character in and one out. The sum is kept in millionths, so every engine gets the same decisions.
Candidates that the allow list names, or that touch a base span, are no finding.

Null and empty texts have no spans. Offsets are code points, ends exclusive. Rows repeat as they come; an empty table gives
an empty result; columns of the input beyond ``id_col`` and ``text_col`` are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 20


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + f"|{_any_case('api')}_?{_any_case('key')}"
#: Kind, pattern, and the least length of a match; of ``assign`` the length of group 2 counts.
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
KINDS = {"assign": 0, "access": 1, "hex": 2, "entropy": 3}
ALLOW = "example|sample|dummy|placeholder|changeme|0123456789|abcdefghij"
UUID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
#: Least entropy in bits of some window, by character class.
LEAST_BITS = {"hex": 3.0, "mixed": 3.7}
HEX_CHARS = "0123456789abcdefABCDEF"
MIXED_CHARS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
#: c * log2(c) in millionths, for c = 0 .. WINDOW.
WEIGHT = [0, *(round(1e6 * c * math.log2(c)) for c in range(1, WINDOW + 1))]
#: The entropy reaches the least when the sum of weights is at most this.
MOST = {k: round(1e6 * WINDOW * (math.log2(WINDOW) - v)) for k, v in LEAST_BITS.items()}


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, hit>> of the matches, in order. None may be empty."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    kind = "array<struct<start:int,stop:int,hit:string>>"
    step = lambda s, x: F.struct(
        (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
        F.concat(
            s["out"],
            F.array(F.struct((s["at"] + F.length(x["gap"])).alias("start"), (s["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("stop"), x["hit"].alias("hit"))),
        ).alias("out"),
    )
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"))
    made = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast(kind))


def least_weight(value: Column, chars: str) -> Column:
    """The least sum of weights over all windows of ``value``, from counts that are updated character by character."""
    weight = F.array(*(F.lit(x).cast("long") for x in WEIGHT))
    n = len(chars)
    at = lambda ch: F.instr(F.lit(chars), ch) - 1
    count = lambda counts, ch: F.get(counts, at(ch))
    w = lambda c: F.get(weight, c)

    def step(s: Column, ch: Column) -> Column:
        out = F.when(F.size(s["win"]) == WINDOW, F.get(s["win"], 0)).otherwise(F.lit(""))
        full = F.size(s["win"]) >= WINDOW - 1
        gone = F.when(out == "", F.lit(0).cast("long")).otherwise(w(count(s["n"], out) - 1) - w(count(s["n"], out)))
        now = count(s["n"], ch) - F.when(out == ch, 1).otherwise(0)
        total = s["s"] + gone + w(now + 1) - w(now)
        return F.struct(
            F.slice(F.concat(s["win"], F.array(ch)), F.when(out == "", 1).otherwise(2), WINDOW).alias("win"),
            F.transform(s["n"], lambda c, j: c - F.when((out != "") & (j == at(out)), 1).otherwise(0) + F.when(j == at(ch), 1).otherwise(0)).alias("n"),
            total.alias("s"),
            F.when(full, F.least(s["m"], total)).otherwise(s["m"]).alias("m"),
        )

    zero = F.struct(F.array().cast("array<string>").alias("win"), F.array_repeat(F.lit(0), n).alias("n"), F.lit(0).cast("long").alias("s"), F.lit(2**62).cast("long").alias("m"))
    return F.aggregate(F.split(value, ""), zero, step, lambda s: s["m"])


def suspicious(value: Column) -> Column:
    listed = F.lower(value).rlike(ALLOW) | value.rlike(UUID)
    hexed = value.rlike("^[0-9a-fA-F]+$")
    return (
        value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~listed
        & F.when(hexed, least_weight(value, HEX_CHARS) <= MOST["hex"]).otherwise(least_weight(value, MIXED_CHARS) <= MOST["mixed"])
    )


def _tag(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS[kind]).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``base`` and ``extra``, arrays of (start, rank, stop, kind) in order of start, then kind."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = df.select(
        F.col(id_col),
        spans_of(text, ASSIGN).alias("_assign"), spans_of(text, ACCESS).alias("_access"), spans_of(text, HEX).alias("_hex"), spans_of(text, CANDIDATE).alias("_long"),
    )
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 12
    base = F.concat(_tag("assign", F.filter("_assign", value)), _tag("access", F.col("_access")), _tag("hex", F.col("_hex")))
    found = found.select(id_col, F.array_sort(base).alias("base"), "_long")
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["stop"]) & (b["stop"] > s["start"]))
    return found.select(id_col, "base", _tag("entropy", F.filter("_long", lambda s: F.when(free(s), suspicious(s["hit"])).otherwise(False))).alias("extra"))


def digest(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns, and ``n_entropy``."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(df, id_col, text_col).select(
        F.col(id_col),
        count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "extra"))).alias("spans"),
        F.size("extra").cast("long").alias("n_entropy"),
    )


def oracle() -> str:
    """The same in DuckDB, over ``documents``."""
    weights = "[" + ",".join(map(str, WEIGHT)) + "]"
    assign, quote = ASSIGN.replace("'", "''"), lambda kind, pattern, where: f"""
      SELECT r, '{kind}' AS kind, {KINDS[kind]} AS rank, start, start + length(hit) AS stop, hit FROM (
        SELECT r, hit, (sum(length(gap) + length(hit)) OVER (PARTITION BY r ORDER BY i) - length(hit))::INT AS start FROM (
          SELECT r, unnest(h) AS hit, unnest(g[1:len(h)]) AS gap, unnest(range(len(h))) AS i FROM (
            SELECT r, regexp_extract_all(t, '{pattern}') AS h, string_split_regex(t, '{pattern}') AS g FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE {where}"""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    base AS ({quote("assign", assign, f"length(regexp_extract(hit, '{assign}', 2)) >= 12")}
      UNION ALL {quote("access", ACCESS, "true")} UNION ALL {quote("hex", HEX, "true")}),
    cand AS ({quote("entropy", CANDIDATE, f"regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') AND NOT regexp_matches(lower(hit), '{ALLOW}') AND NOT regexp_matches(hit, '{UUID}')")}),
    win AS (SELECT r, start, stop, hit, unnest(range(1, length(hit) - {WINDOW - 2})) AS p FROM cand c
      WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.start < c.stop AND b.stop > c.start)),
    chars AS (SELECT r, start, stop, hit, p, unnest(string_split(substr(hit, p, {WINDOW}), '')) AS ch FROM win),
    counts AS (SELECT r, start, stop, hit, p, ch, count(*) AS c FROM chars GROUP BY ALL),
    sums AS (SELECT r, start, stop, hit, p, sum({weights}[c + 1]) AS s FROM counts GROUP BY ALL),
    extra AS (SELECT r, 'entropy' AS kind, 3 AS rank, start, stop FROM sums GROUP BY r, start, stop, hit
      HAVING min(s) <= CASE WHEN regexp_matches(hit, '^[0-9a-fA-F]+$') THEN {MOST["hex"]} ELSE {MOST["mixed"]} END),
    b AS (SELECT r, count(*) FILTER (kind = 'assign') AS na, count(*) FILTER (kind = 'access') AS nc, count(*) FILTER (kind = 'hex') AS nh,
      string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS j FROM base GROUP BY r),
    a AS (SELECT r, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS j, count(*) FILTER (kind = 'entropy') AS ne
      FROM (SELECT r, kind, rank, start, stop FROM base UNION ALL SELECT r, kind, rank, start, stop FROM extra) GROUP BY r)
    SELECT doc_id, coalesce(na, 0) AS n_assign, coalesce(nc, 0) AS n_access, coalesce(nh, 0) AS n_hex, sha256(coalesce(b.j, '')) AS base_sha256,
      coalesce(a.j, '') AS spans, coalesce(ne, 0) AS n_entropy
    FROM d LEFT JOIN b USING (r) LEFT JOIN a USING (r)"""
