"""Secret detection by fixed patterns, winners by line, and span redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.schema import SECRET_RANK, lookup

# Fixed values, in order of priority: kind, severity, description, pattern whose group 1 is the secret.
RULES: tuple[tuple[str, str, str, str], ...] = (
    ("private_key", "critical", "PEM private key block", r"(?s)(-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[^-]+-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----)"),
    ("aws_access_key", "high", "AWS Access Key ID", r"\b(AKIA[0-9A-Z]{16})\b"),
    ("aws_secret_key", "high", "AWS Secret Access Key", r"""(?i)(?:aws[_\-\s]?secret[_\-\s]?(?:access[_\-\s]?)?key|aws_secret)\s*[=:]\s*['"]([A-Za-z0-9/+]{40})['"]"""),
    ("google_api_key", "high", "Google / GCP API Key", r"(?<![A-Za-z0-9_])(AIza[0-9A-Za-z\-_]{35,})(?![A-Za-z0-9_])"),
    ("openai_key", "high", "OpenAI API Key", r"\b(sk-[A-Za-z0-9]{20,}(?:T3BlbkFJ[A-Za-z0-9]{20,})?)\b"),
    ("github_token", "high", "GitHub Personal Access Token", r"\b(gh[pousr]_[A-Za-z0-9_]{36,})\b"),
    ("stripe_key", "high", "Stripe API Key", r"\b((?:sk|pk)_(?:live|test)_[A-Za-z0-9]{24,})\b"),
    ("slack_token", "medium", "Slack Token", r"\b(xox[baprs]-[0-9A-Za-z\-]{10,})\b"),
    ("jwt_token", "medium", "JSON Web Token (JWT)", r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})(?![A-Za-z0-9_-])"),
    ("database_url", "high", "Database connection URL with embedded credentials", r"""(?i)((?:postgresql|postgres|mysql|mongodb(?:\+srv)?|redis|amqp|mssql)\://[^:]+:[^@\s'"]+@[^\s'"]+)"""),
    ("password", "medium", "Password / secret assignment", r"""(?is)(?:password|passwd|pass|pwd|secret).{0,40}?=\s*['"]([^'"]{6,})['"]"""),
    ("token", "medium", "Generic API key / token assignment", r"""(?i)(?:api[_\-]?key|access[_\-]?token|auth[_\-]?token|bearer[_\-]?token|secret[_\-]?key|private[_\-]?key)\s*[=:]\s*['"]([^'"]{8,})['"]"""),
    ("generic_secret", "low", "High-entropy string in a key/token/secret variable", r"""(?i)(?:key|token|secret|credential)\s*[=:]\s*['"]([A-Za-z0-9+/=_\-]{16,})['"]"""),
)
#: Least entropy in bits a character of the optional second detector, by alphabet.
ENTROPY_LEAST = {"hex": 3.0, "base64": 4.5}


HIT = "struct<start:int,stop:int,value:string,rule:int,kind:string,severity:string,description:string>"
#: A text without any of these has no hit: one scan spares the others.
HINTS = r"(?i)-----BEGIN|AKIA|aws|AIza|sk-|gh[pousr]_|[sp]k_|xox|eyJ|://|pass|pwd|secret|key|token|credential"


def _rule_hits(text: Column, rule: int) -> Column:
    """Hits of one rule with the offsets of group 1; one fold over gaps and matches."""
    kind, severity, about, pattern = RULES[rule]
    whole, values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(whole))
    # A value ends its match, but for the quote that closes an assignment.
    tail = 1 if pattern.endswith("""['"]""") else 0

    def step(s: Column, x: Column) -> Column:
        stop = s["at"] + F.length(x["gap"]) + F.length(x["whole"])
        hit = F.struct(
            (stop - tail - F.length(x["value"])).alias("start"), (stop - tail).alias("stop"), x["value"].alias("value"), F.lit(rule).alias("rule"),
            F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(about).alias("description"),
        )
        return F.struct(stop.alias("at"), F.concat(s["out"], F.array(hit)).alias("out"))

    zipped = F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), values.alias("value"))
    found = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{HIT}>").alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(f"array<{HIT}>"))


def hits_of(text: Column, rules: tuple[str, ...] | None = None) -> Column:
    """All hits of a text, of the rules named or of all."""
    wanted = [k for k, r in enumerate(RULES) if rules is None or r[0] in rules]
    return F.when(text.rlike(HINTS), F.concat(*(_rule_hits(text, k) for k in wanted))).otherwise(F.array().cast(f"array<{HIT}>"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[str, ...] | None = None) -> DataFrame:
    """One row a hit: id, kind, severity, line, col, start, stop, value, masked, placeholder, description, rule, detector."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    hits = docs.select(F.col(id_col), body.alias("_t"), F.explode(hits_of(body, rules)).alias("h"))
    at = T.line_of(F.col("_t"), F.col("h.start"))
    hits = hits.select(id_col, "h.*", at.alias("at"))
    return hits.select(
        id_col, "kind", "severity", F.col("at.line").alias("line"), F.col("at.col").alias("col"), "start", "stop", "value",
        T.mask(F.col("value")).alias("masked"), T.placeholder(F.col("kind"), F.col("at.line")).alias("placeholder"), "description", "rule", F.lit("regex").alias("detector"),
    )


def best_per_line(hits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of the hits of a line: the most severe, then the first, then the rule of higher priority."""
    w = Window.partitionBy(id_col, "line").orderBy(lookup(SECRET_RANK, F.col("severity"), 1).desc(), "start", "rule")
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def entropy_bits(value: Column) -> Column:
    """Shannon entropy in bits a character."""
    chars = F.split(value, "")
    n = F.size(chars).cast("double")
    p = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s - p(c) * F.log2(p(c)))


# Kind and severity of the second detector's hits.
ENTROPY_KIND, ENTROPY_SEVERITY = "detect_secrets_finding", "medium"
QUOTED = r"""["']([A-Za-z0-9+/=_-]{16,})["']"""


def _entropic(value: Column) -> Column:
    least = F.when(value.rlike("^[0-9a-fA-F]+$"), ENTROPY_LEAST["hex"]).otherwise(ENTROPY_LEAST["base64"])
    return entropy_bits(value) >= least


def entropy_hits(docs: DataFrame, hits: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Quoted strings of high entropy on lines that no pattern covers. Ids must be unique; ``sanitize`` needs no ids."""
    rows = docs.select(F.col(id_col), F.posexplode(F.split(F.col(text_col), "\n")).alias("_p", "_line"))
    rows = rows.select(id_col, (F.col("_p") + 1).alias("line"), F.explode(F.regexp_extract_all("_line", F.lit(QUOTED), F.lit(1))).alias("value"))
    rows = rows.where(_entropic(F.col("value"))).select(id_col, "line", "value", F.lit(ENTROPY_KIND).alias("kind"), F.lit(ENTROPY_SEVERITY).alias("severity"), F.lit("entropy").alias("detector"))
    return rows.join(hits.select(id_col, "line").distinct(), [id_col, "line"], "left_anti")


def sanitize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", all_kinds: bool = False, entropy: bool = False) -> DataFrame:
    """``docs`` with sanitized, n_secrets, highest and findings: the winner of each line, as (line, kind, severity, start, masked, placeholder, detector).

    The spans of a line's winning kind are replaced; with ``all_kinds`` all are. With ``entropy``, quoted strings of high entropy
    on lines without a hit are found and replaced too. All is done within the row: rows of equal ids don't meet, nothing is shuffled.
    Overlapping spans: the first stands.
    """
    rows = docs.withColumn("_t", F.coalesce(F.col(text_col), F.lit(""))).withColumn("_found", hits_of(F.col("_t")))
    lined = lambda h: T.line_of(F.col("_t"), h["start"])["line"]
    rank = lambda h: -lookup(SECRET_RANK, h["severity"], 1)
    item = lambda h, detector: F.struct(
        lined(h).alias("line"), rank(h).alias("rank"), h["start"].alias("start"), h["rule"].alias("rule"), h["stop"].alias("stop"), h["kind"].alias("kind"),
        h["severity"].alias("severity"), T.mask(h["value"]).alias("masked"), F.lit(detector).alias("detector"),
    )
    rows = rows.withColumn("_hits", F.array_sort(F.transform("_found", lambda h: item(h, "regex"))))
    if entropy:
        # Gaps and matches of the quoted strings, as for a rule; a value stands one before the closing quote.
        whole, values = F.regexp_extract_all("_t", F.lit(QUOTED), F.lit(0)), F.regexp_extract_all("_t", F.lit(QUOTED), F.lit(1))
        zipped = F.arrays_zip(F.slice(F.split("_t", QUOTED, -1), 1, F.size(whole)).alias("gap"), whole.alias("whole"), values.alias("value"))

        def step(s: Column, x: Column) -> Column:
            stop = s["at"] + F.length(x["gap"]) + F.length(x["whole"])
            hit = F.struct(
                (stop - 1 - F.length(x["value"])).alias("start"), (stop - 1).alias("stop"), x["value"].alias("value"), F.lit(len(RULES)).alias("rule"),
                F.lit(ENTROPY_KIND).alias("kind"), F.lit(ENTROPY_SEVERITY).alias("severity"), F.lit("").alias("description"),
            )
            return F.struct(stop.alias("at"), F.when(_entropic(x["value"]), F.concat(s["out"], F.array(hit))).otherwise(s["out"]).alias("out"))

        more = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{HIT}>").alias("out")), step, lambda s: s["out"])
        free = F.filter(F.transform(more, lambda h: item(h, "entropy")), lambda x: ~F.array_contains(F.col("_hits.line"), x["line"]))
        rows = rows.withColumn("_hits", F.array_sort(F.concat("_hits", free)))
    # In this order the first hit of each line is its winner.
    rows = rows.withColumn("_best", F.filter("_hits", lambda x, i: (i == 0) | (F.get("_hits", i - 1)["line"] != x["line"])))
    kinds = F.map_from_arrays(F.col("_best.line"), F.col("_best.kind"))
    chosen = F.col("_hits") if all_kinds else F.filter("_hits", lambda x: x["kind"] == F.element_at(kinds, x["line"]))
    spans = F.array_sort(F.transform(chosen, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), T.placeholder(x["kind"], x["line"]).alias("text"))))
    rows = rows.withColumn("_spans", F.array_distinct(spans))
    # What an earlier span covers is left to it.
    ends = F.transform("_spans", lambda x, i: F.coalesce(F.array_max(F.slice(F.col("_spans.stop"), 1, i)), F.lit(0)))
    rows = rows.withColumn("_ends", F.when(F.size("_spans") > 0, ends))
    parts = F.transform("_spans", lambda x, i: F.when(x["start"] >= F.get("_ends", i), F.concat(F.substr(F.col("_t"), F.get("_ends", i) + 1, x["start"] - F.get("_ends", i)), x["text"])).otherwise(F.lit("")))
    last = F.substr(F.col("_t"), F.array_max("_spans.stop") + 1)
    out = F.when(F.size("_spans") == 0, F.col("_t")).otherwise(F.concat(F.array_join(parts, ""), last))
    shown = F.transform("_best", lambda x: F.struct(
        x["line"].alias("line"), x["kind"].alias("kind"), x["severity"].alias("severity"), x["start"].alias("start"), x["masked"].alias("masked"), T.placeholder(x["kind"], x["line"]).alias("placeholder"), x["detector"].alias("detector")))
    highest = F.get(F.array_sort(F.transform("_best", lambda x: F.struct(x["rank"].alias("rank"), x["severity"].alias("severity")))), F.lit(0))["severity"]
    rows = rows.withColumns({"sanitized": out, "n_secrets": F.size("_best"), "highest": highest, "findings": shown})
    return rows.drop("_t", "_found", "_hits", "_best", "_spans", "_ends")
