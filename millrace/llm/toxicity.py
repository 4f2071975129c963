"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of hashed embeddings of the word, its prefixes and its suffix. Filters of widths 1 to 3 slide over
the whole text; each keeps its maximum, and a logistic layer adds the kept values. Convolution is linear, so at scoring time
the products of a word's vector with all filters are computed once per distinct word, kept in a bounded table, and a text costs
a look-up and additions a word.

The sample that the model is fitted on is bounded: at most ``SAMPLE`` labelled rows of each class, of any length, the first by a
hash of the id, and never a held-out row. Executors turn their whole texts into the buckets of each word, eight bytes a word, so neither texts nor words come to the
driver, which keeps four bytes a word and the distinct buckets; a step of the fit takes a text in slices. A quarter of the sample is kept from training. All
labelled rows that are neither held out nor trained on are then scored whole by the executors, and histograms of their
logits set the level that maps to a score of 0.5, and a threshold for each language. A language without rows of both classes takes
0.5; if those rows together lack a class, the trained rows count as well. Language moves the threshold only, never the score.

Null and empty texts get the score of a text without words. Labels that are null are ignored; of several labels of one id the
largest holds, and of several texts of one id the fit reads the one of the smallest hash. Without labels of both classes every
score is 0. Rows repeat as they come; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_bitmap

SAMPLE = 2500
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
EPOCHS, RATE, SEED = 12, 0.15, 7
TABLE_ROWS = 200_000
SLICE = 8192
#: Bins of a unit of the logit; logits are cut to +-40.
BINS = 50
OFFSETS = np.cumsum([0, *WIDTHS])


def features(token: str) -> tuple[int, int, int, int]:
    """Buckets of a token: word, prefixes of 4 and 5, suffix of 3; marks around the word are not part of it."""
    word = token.lower().strip("\"'.,;:!?()[]{}<>*#$%&|_-~`/\\…«»“”‘’¿¡").encode("utf-8", "surrogatepass")
    text = word.decode("utf-8", "surrogatepass")
    h = lambda tag, x: zlib.crc32(tag + x.encode("utf-8", "surrogatepass")) % BUCKETS
    return h(b"w", text), h(b"4", text[:4]), h(b"5", text[:5]), h(b"s", text[-3:])


@dataclass
class Model:
    embed: np.ndarray
    filters: np.ndarray  # (sum of WIDTHS, DIM, FILTERS): the parts of each width follow each other
    bias: np.ndarray  # (len(WIDTHS), FILTERS)
    out: np.ndarray  # (len(WIDTHS), FILTERS)
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)  # by language, on the score

    def pooled(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima and their places, from the parts (words, sum of WIDTHS, FILTERS) of a text padded by two zero words."""
        n = len(parts) - WIDTHS[-1] + 1
        best, place = np.empty((len(WIDTHS), FILTERS), "f4"), np.empty((len(WIDTHS), FILTERS), "i8")
        for k, width in enumerate(WIDTHS):
            z = parts[:n, OFFSETS[k]].copy()
            for j in range(1, width):
                z += parts[j : n + j, OFFSETS[k] + j]
            place[k] = z.argmax(0)
            best[k] = z[place[k], np.arange(FILTERS)]
        return best, place

    def logit(self, best: np.ndarray) -> float:
        return float((np.maximum(best + self.bias, 0) * self.out).sum()) + self.shift


class Vocabulary:
    """Numbers of words, and the buckets of each."""

    def __init__(self) -> None:
        self.numbers: dict[str, int] = {}
        self.rows: list[tuple[int, int, int, int]] = []

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        for w in words:
            if w not in self.numbers:
                self.numbers[w] = len(self.rows)
                self.rows.append(features(w))
        return np.fromiter(map(self.numbers.__getitem__, words), "i4", len(words))


def packed(text: str | None, known: dict[str, int]) -> bytes:
    """The words of a text, 16 bits a bucket."""
    words = (text or "").split()
    for w in words:
        if w not in known:
            a, b, c, d = features(w)
            known[w] = a | b << 16 | c << 32 | d << 48
    return np.fromiter(map(known.__getitem__, words), "u8", len(words)).tobytes()


def packed_texts(text: str) -> Column:
    @F.pandas_udf("binary")
    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, int] = {}
        for texts in batches:
            if len(known) > TABLE_ROWS:
                known.clear()
            yield texts.map(lambda t: packed(t, known))

    return each(text)


def numbered(docs: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """Words of packed texts as numbers, and the buckets of each number."""
    words = [np.frombuffer(d, "u8") for d in docs]
    known = np.unique(np.concatenate([np.empty(0, "u8"), *words]))
    table = np.stack([(known >> np.uint64(16 * k) & np.uint64(BUCKETS - 1)).astype("i4") for k in range(4)], 1)
    return [np.searchsorted(known, w).astype("i4") for w in words], table


def _vectors(model: Model, ids: np.ndarray) -> np.ndarray:
    e = model.embed[ids].sum(1)
    e[ids[:, 0] < 0] = 0
    return e


def _maxima(model: Model, table: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maxima and their places of a whole text, by slices that share the words which a filter spans. Zero words follow the text."""
    best, place, edge = None, None, WIDTHS[-1] - 1
    for at in range(0, max(1, len(doc)), SLICE):
        part = doc[at : at + SLICE + edge]
        wanted = min(SLICE, max(1, len(doc) - at)) + edge
        ids = np.concatenate([table[part], np.full((wanted - len(part), 4), -1)]) if len(part) < wanted else table[part]
        here, where = model.pooled(np.einsum("ld,pdf->lpf", _vectors(model, ids), model.filters, optimize=True))
        if best is None:
            best, place = here, where
        else:
            more = here > best
            best, place = np.where(more, here, best), np.where(more, where + at, place)
    return best, place


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Model:
    known = Vocabulary()
    return fit_numbers([known(t) for t in texts], np.array(known.rows, "i8").reshape(-1, 4), labels, epochs)


def fit_numbers(docs: list[np.ndarray], table: np.ndarray, labels: list[int], epochs: int = EPOCHS) -> Model:
    """Per-text Adagrad steps through the places of the maxima. ``docs``: rows of ``table``, the buckets of each word."""
    rng = np.random.default_rng(SEED)
    model = Model(
        rng.normal(0, 0.1, (BUCKETS, DIM)).astype("f4"), rng.normal(0, 0.3, (OFFSETS[-1], DIM, FILTERS)).astype("f4"),
        np.zeros((len(WIDTHS), FILTERS), "f4"), rng.normal(0, 0.3, (len(WIDTHS), FILTERS)).astype("f4"),
    )
    y = np.asarray(labels, "f4")
    weight = np.where(y == 1, len(y) / max(1, 2 * y.sum()), len(y) / max(1, 2 * (1 - y).sum()))
    seen = {k: np.full_like(getattr(model, k), 0.1) for k in ("embed", "filters", "bias", "out")}
    part_of = np.concatenate([np.full(w, k) for k, w in enumerate(WIDTHS)])
    step_of = np.concatenate([np.arange(w) for w in WIDTHS])

    def move(name: str, grad: np.ndarray, at=slice(None)) -> None:
        seen[name][at] += grad * grad
        getattr(model, name)[at] -= RATE * grad / np.sqrt(seen[name][at])

    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            doc = docs[i]
            best, place = _maxima(model, table, doc)
            a = np.maximum(best + model.bias, 0)
            d = float(weight[i]) * (1 / (1 + np.exp(-np.clip((a * model.out).sum() + model.shift, -30, 30))) - y[i])
            if abs(d) < 1e-3:
                continue
            da = d * model.out * (a > 0)
            places = place[part_of] + step_of[:, None]  # (parts, FILTERS): the word under each part of each filter
            rows, inverse = np.unique(places.ravel(), return_inverse=True)
            inside = rows < len(doc)
            ids = np.full((len(rows), 4), -1, "i8")
            ids[inside] = table[doc[rows[inside]]]
            touched, flat = _vectors(model, ids)[inverse].reshape(*places.shape, DIM), da[part_of]
            gf = np.einsum("pfd,pf->pdf", touched, flat)
            ge = (model.filters.transpose(0, 2, 1) * flat[:, :, None]).reshape(-1, DIM)
            gw = np.zeros((len(rows), DIM), "f4")
            np.add.at(gw, inverse, ge)
            for f in range(4):
                at, back = np.unique(ids[inside, f], return_inverse=True)
                g = np.zeros((len(at), DIM), "f4")
                np.add.at(g, back, gw[inside])
                move("embed", g, at)
            move("out", d * a)
            move("bias", da)
            move("filters", gf)
            model.shift -= 0.02 * d
    return model


class Scorer:
    """Scores whole texts; the table of words is emptied when it is full."""

    def __init__(self, model: Model):
        self.model = model
        self.flat = model.filters.transpose(1, 0, 2).reshape(DIM, -1)
        self._reset()

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.parts = np.zeros((1024, OFFSETS[-1], FILTERS), "f4")  # row 0: no word

    def _learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if not new:
            return
        first = len(self.index) + 1
        if first + len(new) > len(self.parts):
            self.parts = np.concatenate([self.parts, np.zeros((max(len(self.parts), len(new)), *self.parts.shape[1:]), "f4")])
        e = self.model.embed[np.array([features(w) for w in new], "i8")].sum(1)
        self.parts[first : first + len(new)] = (e @ self.flat).reshape(len(new), OFFSETS[-1], FILTERS)
        self.index.update(zip(new, range(first, first + len(new)), strict=True))

    def logit(self, text: str | None) -> float:
        words = (text or "").split()
        if len(self.index) > TABLE_ROWS:
            self._reset()
        best = None
        edge = WIDTHS[-1] - 1
        for at in range(0, max(1, len(words)), SLICE):
            part = words[at : at + SLICE + edge]
            self._learn(part)
            ids = np.zeros(max(len(part), min(SLICE, max(1, len(words) - at))) + edge, "i8")
            ids[: len(part)] = np.fromiter(map(self.index.__getitem__, part), "i8", len(part))
            here, _ = self.model.pooled(self.parts[ids])
            best = here if best is None else np.maximum(best, here)
        return self.model.logit(best)


def _best_level(z: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> float:
    """The level between two neighbours of the ascending ``z`` with the fewest errors; ties take the middle of the widest."""
    missed = np.concatenate([[0], np.cumsum(pos)])  # positives below the level
    raised = neg.sum() - np.concatenate([[0], np.cumsum(neg)])  # negatives above it
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    wide = np.concatenate([[1], z[1:] - z[:-1], [1]])
    cost = missed + raised
    least = np.flatnonzero(cost == cost.min())
    return float(edges[least[np.argmax(wide[least])]])


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """The bounded sample is fitted on the driver, all other labelled rows calibrate. None without rows of both classes."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max(label_col).alias("_y"))
    key = F.xxhash64(id_col)
    picked = known.where("_y > 0").orderBy(key, id_col).limit(sample).unionByName(known.where("_y <= 0").orderBy(key, id_col).limit(sample))
    texts = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.coalesce(text_col, F.lit("")).alias("_text"))
    # Of fixed size: 2 x sample rows of an id and a label.
    found = texts.join(F.broadcast(picked), F.col("_id") == F.col(id_col))
    rows = found.groupBy("_id", "_y").agg(F.min(F.struct("_h", "_text")).alias("_t")).select("_id", "_t._text", "_y")
    rows = [tuple(r) for r in rows.withColumn("_text", packed_texts("_text")).toLocalIterator()]
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
    y = np.array([int(r[2] > 0) for r in rows])
    if len(set(y)) < 2:
        return None
    check = np.arange(len(rows)) % 4 == 3
    if len(set(y[~check])) < 2:
        check = np.zeros(len(rows), bool)
    texts, table = numbered([r[1] for r, c in zip(rows, check, strict=True) if not c])
    rows = [(r[0],) for r in rows]
    model = fit_numbers(texts, table, list(y[~check]))
    trained = docs.sparkSession.createDataFrame([(rows[i][0],) for i in np.flatnonzero(~check)], docs.select(F.col(id_col).alias("_id")).schema)
    every = docs.where(F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang"))
    for used in (every.join(F.broadcast(trained), "_id", "left_anti"), every):
        found = _histogram(used, known.select(F.col(id_col).alias("_id"), "_y"), model)
        if found["pos"].any() and found["neg"].any():
            break
    at = lambda h: _best_level(*(h.groupby("bin")[["pos", "neg"]].sum().reset_index()[c].to_numpy("f8") for c in ("bin", "pos", "neg"))) / BINS
    level = at(found)
    model.shift -= level
    for lang, own in found.groupby("lang"):
        both = own["pos"].any() and own["neg"].any()
        model.thresholds[lang] = float(1 / (1 + np.exp(-((at(own) if both else level) - level))))
    return model


def _histogram(rows: DataFrame, known: DataFrame, model: Model) -> pd.DataFrame:
    """lang, bin, pos, neg: labelled rows by bins of the logit. Only scores are shuffled, never texts."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("long")
    def binned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield pd.Series(np.rint(np.clip(np.array([scorer.logit(t) for t in texts], "f8"), -40, 40) * BINS).astype("i8"))

    # A filter before the scoring; what passes by chance is left to the join.
    known = known.withColumn("_h", F.xxhash64("_id"))
    likely = in_bitmap(rows.withColumn("_h", F.xxhash64("_id")), "_h", known, "_h")
    scored = likely.select("_id", F.col("_lang").cast("string").alias("lang"), binned("_text").alias("bin"))
    counts = scored.join(known.drop("_h"), "_id").groupBy("lang", "bin").agg(F.count(F.when(F.col("_y") > 0, 1)).alias("pos"), F.count(F.when(F.col("_y") <= 0, 1)).alias("neg"))
    return pd.DataFrame([tuple(r) for r in counts.collect()], columns=["lang", "bin", "pos", "neg"])


def score(docs: DataFrame, model: Model | None, text_col: str = "text") -> Column:
    if model is None:
        return F.lit(0.0)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: BUCKETS x DIM floats and the filters

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            z = np.array([scorer.logit(t) for t in texts], "f8")
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    return scored(F.col(text_col))


def rejects(model: Model | None, score_col: str = "score", lang_col: str = "lang") -> Column:
    """True where the score reaches the threshold of the row's language, 0.5 for a language without labelled rows."""
    found = F.lit(0.5)
    for lang, t in sorted(model.thresholds.items() if model else ()):
        found = F.when(F.col(lang_col) == lang, F.lit(t)).otherwise(found)
    return F.coalesce(F.col(score_col) >= found, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(docs, labels)
    scored = docs.select("doc_id", "lang", held_out("doc_id").alias("held_out"), score(docs, model).alias("score"))
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"), rejects(model).alias("rejected"))
