"""Short reference texts on common weaknesses, which a scan may be given, and their store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import search
from millrace.sources.store import Table

#: id, CWE, severity, category, title, how it looks, what to do.
NOTES = (
    ("weak-sql", "CWE-89", "critical", "injection", "SQL built from input", "A statement is put together by +, % or f-strings from values that a caller controls, and executed.", "Pass values as parameters of the statement; let an allow-list choose table and column names."),
    ("weak-shell", "CWE-78", "critical", "injection", "Shell command built from input", "os.system, or subprocess with shell=True, gets a string that holds a caller's value.", "Give subprocess a list of arguments without a shell, and check each against what is expected."),
    ("weak-eval", "CWE-95", "critical", "injection", "Input is evaluated as code", "eval, exec or compile runs text that came from outside.", "Parse the text: ast.literal_eval for literals, json.loads for data, a table of allowed functions for calls."),
    ("weak-request", "CWE-918", "high", "request_forgery", "Server fetches an address of the caller", "requests.get or urlopen is called with an address from a request, so internal hosts can be reached.", "Resolve the host, refuse private and link-local ranges, allow known hosts only, and don't follow redirects blindly."),
    ("weak-path", "CWE-22", "high", "path_traversal", "File path built from input", "A name with ../ or an absolute path is joined to a folder and opened.", "Resolve the joined path and check that it lies under the folder; keep a table from keys to files where possible."),
    ("weak-unpickle", "CWE-502", "critical", "deserialisation", "Untrusted data is unpickled", "pickle, marshal, shelve or yaml.load without a safe loader read data from outside; objects may run code when they are made.", "Use json, or yaml.safe_load; sign data that must be pickled and check the signature first."),
    ("weak-xml", "CWE-611", "high", "xml", "XML with external entities", "A parser resolves entities of an untrusted document, which read local files or fetch addresses.", "Switch entities and document types off, or use a parser that refuses them."),
    ("weak-hash", "CWE-327", "high", "cryptography", "Weak or home-made cryptography", "MD5 or SHA-1 protects passwords or signatures, ECB mode, a fixed key or vector, random instead of secrets.", "Hash passwords with bcrypt, scrypt or argon2; use authenticated encryption of a known library; draw from secrets."),
    ("weak-forgery", "CWE-352", "medium", "web", "State changes without proof of origin", "A handler changes state on a cookie alone, or any origin is allowed with credentials.", "Require a token a session, set SameSite on cookies, and name the origins that are allowed."),
    ("weak-script", "CWE-79", "high", "web", "Input is shown as markup", "Text from outside reaches a page unescaped: mark_safe, |safe, innerHTML, string templates.", "Escape by default in the template; clean what must hold markup with an allow-list."),
    ("weak-secret", "CWE-798", "high", "secrets", "Credentials in source", "A key, token or password stands in code or settings that are versioned.", "Read it from the environment or a secret store, and revoke the one that was committed."),
    ("weak-access", "CWE-862", "high", "access", "Missing check of permission", "An object is read or changed by an id from the request without asking whose it is.", "Check the caller's right to this object in the handler, not in the page that links to it."),
    ("weak-race", "CWE-367", "medium", "state", "Check and use apart", "A file or balance is checked and then used, and may change in between.", "Do both in one step: open with exclusive flags, update with a condition, lock the row."),
    ("weak-tls", "CWE-295", "high", "cryptography", "Certificates are not checked", "verify=False or an unverified context makes any server pass for the right one.", "Leave verification on; add the private authority to the bundle."),
)


def notes(spark: SparkSession) -> DataFrame:
    """The texts as rows of a store, without vectors."""
    rows = [(i, title, f"{looks}\nInstead: {fix}", cwe, severity, category, {}) for i, cwe, severity, category, title, looks, fix in NOTES]
    return spark.createDataFrame(rows, "id string, title string, content string, cwe string, severity string, category string, metadata map<string,string>")


def preload(target: Table, make: Callable[[], search.Embedder] = search.HashEmbedder) -> bool:
    """Fills an empty index with the texts; false if it holds rows."""
    rows = search.embedded_documents(search.hashed(notes(target.spark)), make).drop("error")
    return target.preload(rows.withColumn("version", F.lit(0).cast("long")))


def with_knowledge(sources: DataFrame, index: DataFrame, k: int = 3, least: float = 0.0, make: Callable[[], search.Embedder] = search.HashEmbedder) -> DataFrame:
    """``sources`` (review_id, path, source, ..) with ``knowledge``: the k texts of ``index`` nearest to each source, as markdown; null without any."""
    rows = sources.withColumn("qid", F.xxhash64("review_id", "path", "source"))
    asked = rows.select("qid", F.col("source").alias("query")).distinct()
    hits = search.search_codebase(asked, index.where("category <> 'codebase'"), k, make, category=None).where(F.col("relevance") >= least)
    shown = hits.join(index.select("id", "cwe"), "id").select("qid", "rank", F.format_string("### %s (%s)\n%s", "title", "cwe", "content").alias("t"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), "\n\n")
    return rows.join(shown.groupBy("qid").agg(text.alias("knowledge")), "qid", "left").drop("qid")
