"""Model providers behind one interface, called in batches; the default one is deterministic and offline."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import prompts
from millrace.sources.shared import cut

RESPONSE_DDL = "content string, prompt_tokens long, completion_tokens long, latency_ms double, status string, provider string"
#: Schemas of model outputs, for from_json; what does not fit is null and ``valid`` false.
FINDINGS_JSON = "findings array<struct<title:string,description:string,severity:string,confidence:string,affected_code:string,reasoning:string,suggested_remediation:string,line_number:int,cwe_id:string,category:string>>"
FIX_JSON = "proposed_fix string, explanation string"
VERDICT_JSON = "is_acceptable boolean, feedback string"


class Provider(ABC):
    name = "abstract"

    @abstractmethod
    def generate(self, prompt: str, system: str = "") -> str: ...

    def generate_json(self, prompt: str, system: str = "") -> str:
        """An answer that should be JSON; providers with a mode for it use that first."""
        return self.generate(prompt, system)

    def health(self) -> tuple[bool, str]:
        """Whether the provider can answer, and why not."""
        return True, ""


class Stub(Provider):
    """Answers by the kind of request that the prompt's first line names."""

    name = "stub"

    def generate(self, prompt: str, system: str = "") -> str:
        kind = prompt.split("\n", 1)[0].strip("# ").lower()
        if kind.startswith("scan"):
            body = prompt.split("\n\n## Task", 1)[0]
            hits = []
            for n, line in enumerate(body.split("\n")):
                shown = re.match(r" *(\d+) \| ", line)  # the numbers that the prompt shows, where it does
                hits += [(name, int(shown[1]) if shown else n) for name in re.findall(r"\b(eval|exec|os\.system)\(", line)]
            return json.dumps({"findings": [{"title": f"Use of {name}", "severity": "high", "confidence": "medium", "line_number": n, "category": "security"} for name, n in hits]})
        if kind.startswith("logic"):
            return json.dumps({"findings": []})
        if kind.startswith("fix"):
            return json.dumps({"proposed_fix": "pass", "explanation": "placeholder"})
        if kind.startswith("judge"):
            return json.dumps({"is_acceptable": "accept" in kind, "feedback": "" if "accept" in kind else "not acceptable"})
        return f"Summary of {len(prompt)} characters."


class Http(Provider):
    """A JSON endpoint with retries on 429 and 503; ``ask`` builds the request body, ``read`` takes the text from the answer.

    ``ask_json`` builds a request in the endpoint's JSON mode. If that is refused (400, 404, 422), or its answer isn't JSON, the plain
    request is made. ``models`` is the address that lists installed models, ``names`` takes them from its answer.
    """

    def __init__(
        self, name: str, url: str, ask: Callable[[str, str], dict], read: Callable[[dict], str], headers: dict[str, str] | None = None, tries: int = 3, wait: float = 1.5, timeout: float = 60,
        ask_json: Callable[[str, str], dict] | None = None, model: str = "", models: str = "", names: Callable[[dict], list[str]] | None = None, open_url: Callable = urllib.request.urlopen,
    ):
        self.name, self.url, self.ask, self.read, self.headers, self.tries, self.wait, self.timeout = name, url, ask, read, headers or {}, tries, wait, timeout
        self.ask_json, self.model, self.models, self.names, self.open_url = ask_json, model, models, names, open_url

    def _post(self, data: dict) -> str:
        body = json.dumps(data).encode()
        for n in range(1, self.tries + 1):
            try:
                request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", **self.headers})
                with self.open_url(request, timeout=self.timeout) as answer:
                    return self.read(json.load(answer))
            except urllib.error.HTTPError as e:
                if e.code not in (429, 503) or n == self.tries:
                    raise
                time.sleep(self.wait * n)
        raise RuntimeError("unreachable")

    def generate(self, prompt: str, system: str = "") -> str:
        return self._post(self.ask(prompt, system))

    def generate_json(self, prompt: str, system: str = "") -> str:
        if self.ask_json:
            try:
                text = self._post(self.ask_json(prompt, system))
                json.loads(text)
                return text
            except urllib.error.HTTPError as e:
                if e.code not in (400, 404, 422):
                    raise
            except (ValueError, KeyError, IndexError):
                pass
        return self.generate(prompt, system)

    def health(self) -> tuple[bool, str]:
        if not self.models:
            return True, ""
        try:
            with self.open_url(urllib.request.Request(self.models, headers=self.headers), timeout=5) as answer:
                known = ModelNames(tuple(self.names(json.load(answer))))
        except (OSError, ValueError, KeyError) as e:
            return False, f"{self.name} does not answer: {type(e).__name__}"
        return (True, "") if known.has(self.model) else (False, f"{self.name} has no model {self.model}")


def ollama(model: str, host: str = "http://localhost:11434", **options) -> Provider:
    ask = lambda prompt, system: {"model": model, "prompt": prompt, "system": system, "stream": False}
    names = lambda a: [m["name"] for m in a["models"]]
    return Http("ollama", f"{host}/api/generate", ask, lambda a: a["response"], ask_json=lambda p, s: ask(p, s) | {"format": "json"}, model=model, models=f"{host}/api/tags", names=names, **options)


def gemini(model: str, key: str, **options) -> Provider:
    ask = lambda prompt, system: {"contents": [{"parts": [{"text": prompt}]}], "systemInstruction": {"parts": [{"text": system}]}}
    root = "https://generativelanguage.googleapis.com/v1beta/models"
    names = lambda a: [m["name"].removeprefix("models/") for m in a["models"]]
    asked = lambda p, s: ask(p, s) | {"generationConfig": {"responseMimeType": "application/json"}}
    read = lambda a: a["candidates"][0]["content"]["parts"][0]["text"]
    return Http("gemini", f"{root}/{model}:generateContent", ask, read, {"x-goog-api-key": key}, ask_json=asked, model=model, models=root, names=names, **options)


#: Factories by name.
PROVIDERS: dict[str, Callable[..., Provider]] = {"stub": Stub, "ollama": ollama, "gemini": gemini}


@dataclass(frozen=True)
class ModelNames:
    """An installed model matches by full name or by the part before its tag."""

    installed: tuple[str, ...]

    def has(self, model: str) -> bool:
        return any(x == model or x.split(":")[0] == model.split(":")[0] for x in self.installed)


def ask(df: DataFrame, prompt: Column, make: Callable[[], Provider] = Stub, system: str = "", as_json: bool = True) -> DataFrame:
    """``df`` with ``response``: one call a row, in Arrow batches, a provider a worker. An error is a row's status, not the job's end.

    Filter before this: rows that need no call must not reach it. Blank prompts are not sent.
    """

    @F.pandas_udf(f"struct<{', '.join(':'.join(x.strip().split(' ')) for x in RESPONSE_DDL.split(','))}>")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        provider = make()
        send = provider.generate_json if as_json else provider.generate
        for prompts in batches:
            rows = []
            for p in prompts:
                began = time.monotonic()
                try:
                    text, status = (send(p, system), "completed") if (p or "").strip() else ("", "skipped")
                except Exception as e:  # noqa: BLE001
                    text, status = "", f"failed: {type(e).__name__}"
                rows.append((text, max(1, len(p or "") // 4), len(text) // 4, (time.monotonic() - began) * 1000, status, provider.name))
            yield pd.DataFrame(rows, columns=[x.strip().split(" ")[0] for x in RESPONSE_DDL.split(",")])

    return df.withColumn("response", call(prompt))


def written(df: DataFrame) -> DataFrame:
    """Answers are made once, into the folder that all executors share, so a lost executor costs no second call."""
    return cut(df)


def parsed(df: DataFrame, ddl: str) -> DataFrame:
    """``output`` from the response's JSON and ``valid``."""
    return df.withColumn("output", F.from_json(T.clean_json(F.col("response.content")), ddl)).withColumn("valid", F.try_parse_json(T.clean_json(F.col("response.content"))).isNotNull())


def usage(answers: DataFrame, *keys: str) -> DataFrame:
    """Calls, failures, tokens and mean latency of answers, by ``keys``."""
    r = lambda c: F.col(f"response.{c}")
    total = (F.sum(r("prompt_tokens")) + F.sum(r("completion_tokens"))).alias("total_tokens")
    return answers.groupBy(*keys).agg(
        F.count_if(r("status") != "skipped").alias("calls"), F.count_if(r("status").startswith("failed")).alias("failed"), F.sum(r("prompt_tokens")).alias("prompt_tokens"), F.sum(r("completion_tokens")).alias("completion_tokens"), total,
    )


def answers(sources: DataFrame, make: Callable[[], Provider] = Stub, kind: str = "Scan", context: str | None = None, knowledge: str | None = None) -> DataFrame:
    """Sources (review_id, path, source) that aren't blank, with the model's response: made once."""
    prompt = prompts.scan(F.col("path"), F.col("source"), kind, F.col(context) if context else None, F.col(knowledge) if knowledge else None)
    return written(ask(sources.where(F.length(F.trim("source")) > 0), prompt, make))


def findings_of(asked: DataFrame) -> DataFrame:
    """Findings in answers; severity falls back to medium, confidence to high."""
    rows = parsed(asked, FINDINGS_JSON)
    known = lambda c, levels, default: F.when(F.lower(c).isin(*levels), F.lower(c)).otherwise(F.lit(default))
    out = rows.select("review_id", F.col("path").alias("file"), F.posexplode("output.findings").alias("pos", "f"), F.col("response.provider").alias("tool"))
    out = out.select("review_id", "file", "pos", "tool", "f.*")
    return out.withColumn("severity", known("severity", ("critical", "high", "medium", "low", "info"), "medium")).withColumn("confidence", known("confidence", ("high", "medium", "low"), "high"))


def errors_of(asked: DataFrame, producer: str) -> DataFrame:
    """review_id, path, producer, error of the answers that failed or hold no JSON."""
    rows = parsed(asked, FINDINGS_JSON)
    error = F.when(F.col("response.status").startswith("failed"), F.col("response.status")).when((F.col("response.status") == "completed") & ~F.col("valid"), F.lit("failed: no JSON"))
    return rows.select("review_id", "path", F.lit(producer).alias("producer"), error.alias("error")).where("error is not null")


def scan(sources: DataFrame, make: Callable[[], Provider] = Stub, kind: str = "Scan") -> DataFrame:
    """Findings of a model over sources (review_id, path, source)."""
    return findings_of(answers(sources, make, kind))


def summaries(units: DataFrame, make: Callable[[], Provider] = Stub, name: str = "unit_name", snippet: str = "snippet", summary: str = "summary") -> DataFrame:
    """``units`` with the model's summary in place of the one made from parts, where the call gives one."""
    asked = ask(units, prompts.summary(F.col(name), F.col(snippet)), make, as_json=False)
    text = F.when(F.col("response.status") == "completed", F.nullif(F.trim("response.content"), F.lit("")))
    return asked.withColumn(summary, F.coalesce(text, F.col(summary))).drop("response")


class Agent:
    """A provider bound to one kind of call: ``scan`` and ``review`` of sources, ``suggest`` and ``critique`` of fixes."""

    def __init__(self, make: Callable[[], Provider] = Stub):
        self.make = make

    def scan(self, sources: DataFrame) -> DataFrame:
        return scan(sources, self.make, "Scan")

    def review(self, sources: DataFrame) -> DataFrame:
        return scan(sources, self.make, "Logic").withColumn("category", F.lit("business_logic"))

    def suggest(self, findings: DataFrame) -> DataFrame:
        """findings: title, path, code, feedback."""
        fixed = parsed(ask(findings, prompts.fix(), self.make), FIX_JSON)
        return fixed.withColumn("proposed_fix", T.strip_fence(F.coalesce("output.proposed_fix", F.lit("")))).withColumn("explanation", F.coalesce("output.explanation", F.lit(""))).drop("response", "output", "valid")

    def critique(self, fixes: DataFrame) -> DataFrame:
        """fixes: title, code, proposed_fix; an answer that can't be read rejects."""
        judged = parsed(ask(fixes, prompts.judge(), self.make), VERDICT_JSON)
        return judged.withColumn("accepted", F.coalesce("output.is_acceptable", F.lit(False))).withColumn("feedback", F.coalesce("output.feedback", F.lit(""))).drop("response", "output", "valid")
