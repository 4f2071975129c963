"""Scalar functions on text columns. All are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.schema import DEFAULT_LANGUAGE, EMOJI, LANGUAGE_OF, PYTHON_EXTENSIONS, lookup


def extension(path: Column) -> Column:
    """Lower-case suffix of the file name without its dot; none for names such as ``.env`` or ``x.``."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*\.([^./]+)$", 1))


def language(path: Column) -> Column:
    """struct<name, code>."""
    names = {k: v[0] for k, v in LANGUAGE_OF.items()}
    codes = {k: v[1] for k, v in LANGUAGE_OF.items()}
    ext = extension(path)
    return F.struct(lookup(names, ext, DEFAULT_LANGUAGE[0]).alias("name"), lookup(codes, ext, DEFAULT_LANGUAGE[1]).alias("code"))


def is_python(path: Column) -> Column:
    return extension(path).isin(*PYTHON_EXTENSIONS)


def is_diff_payload(text: Column) -> Column:
    head = F.regexp_replace(text, r"(?U)^\s+", "").startswith("## Changed Code for Review")
    return F.coalesce(head | text.contains("```diff") | (text.contains("### File:") & text.contains("**Change Type**")), F.lit(False))


def lines(text: Column) -> Column:
    """Lines as universal line ends give them, without a last empty piece."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", -1)
    return F.when(F.element_at(pieces, -1) == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)


def format_code(text: Column, path: Column) -> Column:
    """Numbered lines in a fence; a diff payload stays as it is but for its end."""
    numbered = F.array_join(F.transform(lines(text), lambda x, i: F.format_string("%4d | %s", i + 1, x)), "\n")
    block = F.concat(F.lit("```"), language(path)["code"], F.lit("\n"), numbered, F.lit("\n```"))
    return F.when(is_diff_payload(text), F.regexp_replace(text, r"(?U)\s+$", "")).otherwise(block)


def placeholder(kind: Column, line: Column) -> Column:
    return F.concat(F.lit("<REDACTED_"), F.upper(kind), F.lit("_L"), line.cast("string"), F.lit(">"))


def mask(value: Column) -> Column:
    """Four characters and up to twelve stars."""
    stars = F.repeat(F.lit("*"), F.least(F.length(value) - 4, F.lit(12)))
    return F.when(F.length(value) <= 4, F.lit("****")).otherwise(F.concat(F.substring(value, 1, 4), stars))


def mask_key(value: Column) -> Column:
    """First and last four characters; short or null values are all stars."""
    shown = F.concat(F.substring(value, 1, 4), F.lit("..."), F.substring(value, -4, 4))
    return F.when(F.length(value) > 8, shown).otherwise(F.lit("****"))


def mask_in(text: Column, key: Column) -> Column:
    return F.when(F.length(key) > 0, F.replace(text, key, mask_key(key))).otherwise(text)


def line_of(text: Column, offset: Column) -> Column:
    """1-based line and 0-based column of a 0-based character offset."""
    before = F.substr(text, F.lit(1), offset)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return F.struct(line.alias("line"), F.length(F.substring_index(before, "\n", -1)).alias("col"))


def normalise_title(text: Column) -> Column:
    """Lower case, punctuation as blanks, single blanks, trimmed; letters and digits of any script stay."""
    words = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w\s]", " ")
    return F.trim(F.regexp_replace(words, r"(?U)\s+", " "))


def title_tokens(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(normalise_title(text), " ")), "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones have 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def short_hash(text: Column, n: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def fingerprint(title: Column, file: Column, line: Column) -> Column:
    """Of normalised title, file and line; line 0 is as null."""
    at = F.when(line != 0, line.cast("string")).otherwise(F.lit(""))
    return short_hash(F.concat_ws("|", normalise_title(title), F.coalesce(file, F.lit("")), F.coalesce(at, F.lit(""))), 16)


def chunk_id(file: Column, scope: Column, old: Column, new: Column) -> Column:
    return short_hash(F.concat_ws(":", file, scope, old.cast("string"), new.cast("string")), 12)


def stable_id(path: Column, name: Column) -> Column:
    return short_hash(F.concat_ws(":", path, name), 16)


def tokens(chars: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(chars / 4).cast("int"))


def display_scope(cls: Column, function: Column) -> Column:
    cls, function = (F.nullif(x, F.lit("")) for x in (cls, function))
    return (
        F.when(function.isNull(), F.lit("<module>"))
        .when(cls.isNull() | function.startswith(F.concat(cls, F.lit("."))), function)
        .otherwise(F.concat(cls, F.lit("."), function))
    )


def relevance(distance: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - distance / 2)), 4)


def percent(score: Column) -> Column:
    return (score * 100).cast("int")


def emoji(severity: Column) -> Column:
    return lookup(EMOJI, severity, "⚫")


def relationship_badge(direct: Column, dependent: Column) -> Column:
    both = F.array_compact(F.array(F.when(direct, "direct dependency"), F.when(dependent, "caller")))
    return F.array_join(both, ", ")


def retrieval_query(name: Column, path: Column, added: Column, summary: Column) -> Column:
    """Name, file stem unless generic, first three code lines added, summary; at most 400 characters."""
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    stem = F.when(~stem.isin("__init__", "utils", "main", "service", "model"), stem)
    code = F.filter(F.transform(added, lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith('"""'))
    first = F.nullif(F.array_join(F.slice(code, 1, 3), " "), F.lit(""))
    return F.substring(F.trim(F.concat_ws(" ", name, stem, first, F.nullif(summary, F.lit("")))), 1, 400)


def snippet(source: Column, start: Column, end: Column, most: int = 40) -> Column:
    """Lines start to end, dedented; lines beyond ``most`` are counted instead."""
    own = F.slice(lines(source), start, F.greatest(F.lit(0), end - start + 1))
    cut = F.when(F.size(own) > most, F.concat(F.slice(own, 1, most), F.array(F.format_string("... (%d more lines)", F.size(own) - most)))).otherwise(own)
    solid = F.filter(cut, lambda x: F.trim(x) != "")
    indent = F.coalesce(F.array_min(F.transform(solid, lambda x: F.length(x) - F.length(F.ltrim(x)))), F.lit(0))
    return F.array_join(F.transform(cut, lambda x: F.substr(x, indent + 1)), "\n")


def unit_summary(kind: Column, name: Column, parent: Column, docstring: Column, decorators: Column, path: Column, line: Column) -> Column:
    """A sentence or more on a code unit, from its parts; what is missing is left out."""
    what = (
        F.when(kind == "class", F.format_string("Class `%s`.", name))
        .when(kind == "method", F.format_string("Method `%s.%s`.", parent, name))
        .otherwise(F.format_string("Function `%s`.", name))
    )
    sentence = F.trim(F.substring_index(docstring, ".", 1))
    doc = F.when(F.length(sentence) > 0, F.concat(sentence, F.lit(".")))
    marks = F.when(F.size(decorators) > 0, F.concat(F.lit("Decorators: "), F.array_join(F.transform(decorators, lambda d: F.concat(F.lit("@"), d)), ", "), F.lit(".")))
    where = F.format_string("Defined in `%s` at line %d.", path, line)
    block = F.format_string("Code chunk `%s` in `%s` at line %d.", name, path, line)
    return F.when(kind == "chunk", block).otherwise(F.concat_ws(" ", what, doc, marks, where))


def clean_json(text: Column) -> Column:
    """The text if it is JSON, else what its fence holds, else its outermost object or array, else itself."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    t = strip(F.coalesce(text, F.lit("")))
    ok = lambda c: F.try_parse_json(c).isNotNull()
    fenced = strip(F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)```$", 1))
    inner = F.when(t.rlike(r"(?s)^```[^\n]*\n.*```$"), fenced).otherwise(t)
    brace, bracket = F.instr(inner, "{"), F.instr(inner, "[")
    as_object = (brace > 0) & ((bracket == 0) | (brace < bracket))
    outer = F.when(as_object, F.regexp_extract(inner, r"(?s)(\{.*\})", 1)).otherwise(F.regexp_extract(inner, r"(?s)(\[.*\])", 1))
    return F.when((t == "") | ok(t), t).when(ok(inner), inner).when(F.length(outer) > 0, outer).otherwise(inner)


def strip_fence(code: Column) -> Column:
    inner = F.regexp_extract(code, r"(?s)^\s*```[^\n]*\n(.*?)\n?```\s*$", 1)
    return F.when(code.rlike(r"(?s)^\s*```[^\n]*\n.*```\s*$"), inner).otherwise(F.trim(code))


def mermaid_id(path: Column) -> Column:
    return F.concat(F.lit("node_"), F.regexp_replace(path, r"[^a-zA-Z0-9_]", "_"))


def relative(path: Column, root: Column) -> Column:
    """POSIX path below the root, or the path itself."""
    p, r = F.replace(path, F.lit("\\"), F.lit("/")), F.concat(F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/")), F.lit("/"))
    return F.when(p.startswith(r), F.substr(p, F.length(r) + 1)).otherwise(p)


def normal_path(path: Column) -> Column:
    """Without ``.`` steps, and ``x/..`` pairs folded."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    fold = lambda s, x: F.when((x == "..") & (F.size(s) > 0) & (F.element_at(s, -1) != ".."), F.slice(s, 1, F.size(s) - 1)).otherwise(F.concat(s, F.array(x)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), fold), "/")


def github_parts(url: Column) -> Column:
    """struct<owner, repo, pull> of a web or SSH address; nulls where it isn't one."""
    web = r"^(?:https?://)?(?:www\.)?github\.com/([\w.-]+)/([\w.-]+?)(?:\.git)?(?:/pull/(\d+))?(?:[/?#].*)?$"
    ssh = r"^git@github\.com:([\w.-]+)/([\w.-]+?)(?:\.git)?$"
    get = lambda i: F.nullif(F.coalesce(F.nullif(F.regexp_extract(url, web, i), F.lit("")), F.regexp_extract(url, ssh, i) if i < 3 else F.lit("")), F.lit(""))
    return F.struct(get(1).alias("owner"), get(2).alias("repo"), get(3).cast("int").alias("pull"))
