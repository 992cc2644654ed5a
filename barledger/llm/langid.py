"""Language identification: multinomial logistic regression on TF-IDF character n-grams, trained by FTRL with elastic-net penalties."""

import re
import struct
import tempfile
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barledger.functions.quantiles import group_quantiles
from barledger.llm.common import row_mapper, settle, texts

#: Hashed n-gram buckets; orders of the n-grams.
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: All labelled rows are dealt by hash into blocks of about so many, each fitted in one task; the model is their mean.
BLOCK_ROWS = 10_000
#: A language has at least so many rows in each block, or all it has (fewer if the languages are many): copies of the same rows.
LEAST_ROWS = 200
#: A block is passed over until about so many steps are done, three times at most.
STEPS, EPOCHS = 8_000, 3
#: Weights are added up in whole units, so that their mean does not depend on the order of the blocks.
UNIT = 2.0**-30
#: Defaults of :func:`sample`, which no fit uses.
ROWS_PER_LANGUAGE, SAMPLE_ROWS = 1000, 40_000
#: Bytes of features kept in memory between passes; more are read again, by tasks from a temporary file.
KEEP_BYTES = 64 << 20
#: A class takes part in a step if its probability is above this, or if it is the row's own.
ACTIVE = 1e-4
#: Share of held-back labelled rows whose score may lie below the least score of an accepted text; and that score at most.
REJECTED_SHARE, HIGHEST_LIMIT = 0.001, 0.5
#: How much rarer than all but that share of held-back rows the n-grams of an accepted text may be.
RARITY_MARGIN = 1.2
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_PRIMES = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))
_PART = 1 << 20  # code points hashed at a time


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages
    idf: np.ndarray
    bias: np.ndarray
    temperature: float
    # calibrated: texts with a lower score or a higher rarity belong to none of the languages
    least_score: float = 0.0
    most_rarity: float = np.inf


def ngram_parts(text: str) -> Iterator[np.ndarray]:
    """Bucket of every n-gram of the whole text (lower case, a space at both ends), in parts of bounded size."""
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    reach = max(ORDERS) - 1
    for lo in range(0, len(points), _PART):
        part = points[lo:lo + _PART + reach]
        value = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            value = (value[:len(part) - n + 1] + part[n - 1:]) * _PRIMES[n % 3] if len(part) >= n else value[:0]
            value ^= value >> np.uint32(15)
            own = value[:_PART]  # n-grams that begin in this part
            if n in ORDERS:
                yield (own & np.uint32(BUCKETS - 1)).astype(np.int64)


def bucket_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that occur in the whole text, ascending, and how often."""
    total: np.ndarray | None = None
    short: list[np.ndarray] = []
    for part in ngram_parts(text):
        if total is None and sum(map(len, short)) + len(part) < 4000:
            short.append(part)
            continue
        total = np.zeros(BUCKETS, dtype=np.int64) if total is None else total
        for p in (*short, part):
            total += np.bincount(p, minlength=BUCKETS)
        short = []
    if total is None:
        return np.unique(np.concatenate(short), return_counts=True)
    at = np.flatnonzero(total)
    return at, total[at]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, over all rows of ``docs``, and the number of rows.

    Tasks add up their rows and send one row per bucket; the sums, ``BUCKETS`` numbers, reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in texts(batch.column(0)):
                total[bucket_counts(text)[0]] += 1
                rows += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], rows))], ["bucket", "n"])

    sums = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in sums:
        found[r["bucket"]] = r["n"]  # -1 is the last: the number of rows
    return found[:-1], int(found[-1])


def sample(train: DataFrame, rows: int = ROWS_PER_LANGUAGE, in_all: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, lang`` of about ``rows`` rows per language (all if it has fewer), ``in_all`` in all.

    A row is in if the hash of its id and text falls below the share that its language may give. No
    language is left out for being rare; the counts per language stay a table.
    """
    counts = settle(train.groupBy("lang").agg(F.count("*").alias("n")))  # a row per language, joined by its measured size
    share = counts.select("lang", (F.lit(float(min(rows, in_all / max(counts.count(), 1)))) / F.col("n")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    return train.join(share, "lang").where(place < F.col("share")).select("doc_id", "text", "lang")


class Features:
    """Sparse features of a bounded sample, in a fixed order: (label, buckets, TF-IDF values), as often as asked for.

    Tasks count the n-grams and write them; the rows come back one partition at a time and stay as
    compact bytes if all of them fit ``keep_bytes``, else every pass reads them again.
    """

    def __init__(self, chosen: DataFrame, keep_bytes: int = KEEP_BYTES):
        def count(rows: pa.RecordBatch) -> pa.RecordBatch:
            at, times = [], []
            for text in texts(rows.column(1)):
                own, count = bucket_counts(text)
                at.append(own.astype("<u4").tobytes())
                times.append(count.astype("<u4").tobytes())
            return pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(at, pa.binary()), pa.array(times, pa.binary())], ["place", "lang", "at", "times"])

        # ids may repeat, so the text breaks ties; equal rows are interchangeable
        rows = chosen.select(F.xxhash64("doc_id", "text").alias("place"), "text", "lang").mapInArrow(row_mapper(count), "place long, lang string, at binary, times binary")
        self._rows = settle(rows).orderBy("place", "lang", F.xxhash64("at", "times"))
        size = self._rows.agg(F.sum(F.octet_length("at") + F.octet_length("times"))).first()[0] or 0
        self.languages = [r[0] for r in self._rows.select("lang").distinct().orderBy("lang").collect()]
        self._kept = list(self._read()) if size <= keep_bytes else None

    def _read(self) -> Iterator[tuple[int, bytes, bytes]]:
        place = {name: i for i, name in enumerate(self.languages)}
        for r in self._rows.toLocalIterator():
            yield place[r["lang"]], bytes(r["at"]), bytes(r["times"])

    def rows(self, idf: np.ndarray, held_back: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(buckets, values, label): every fifth row if ``held_back``, else the others."""
        for i, (label, at, times) in enumerate(self._read() if self._kept is None else self._kept):
            if (i % 5 == 4) == held_back:
                where = np.frombuffer(at, "<u4").astype(np.int64)
                yield where, scale(np.frombuffer(times, "<u4").astype(float), idf[where]), label


def fit_ftrl(passes: Callable[[], Iterable[tuple[np.ndarray, np.ndarray, int]]], classes: int, size: int, epochs: int = 3,
             alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Weights (size x classes) and bias by follow-the-regularised-leader with per-coordinate rates.

    ``passes`` gives the rows once per epoch. ``l1`` keeps a weight at exactly zero until its summed
    gradient exceeds it, ``l2`` shrinks the rest. A step changes only the classes that its row is
    unsure of (``ACTIVE``) and leads them anew; so its cost hardly grows with the number of classes, and
    the state is three numbers of four bytes per bucket and class.
    """
    z, n, w = (np.zeros((size + 1, classes), dtype=np.float32) for _ in range(3))
    for _ in range(epochs):
        for at, values, label in passes():
            at, values = np.append(at, size), np.append(values, 1.0)
            p = softmax(values @ w[at])
            p[label] -= 1.0
            active = np.flatnonzero(np.abs(p) > ACTIVE)
            cells = (at[:, None], active[None, :])
            g = values[:, None] * p[active]
            old = n[cells].astype(float)
            seen = old + g * g
            zs = z[cells] + g - (np.sqrt(seen) - np.sqrt(old)) / alpha * w[cells]
            z[cells], n[cells] = zs, seen
            w[cells] = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(seen)) / alpha + l2))
    return w[:-1], w[-1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_temperature(losses: Callable[[np.ndarray], np.ndarray]) -> float:
    """Temperature of least log loss: ``losses`` of a row of logarithms, thrice, each time finer around the least."""
    lo, hi = np.log(0.05), np.log(20.0)
    for _ in range(3):
        points = np.linspace(lo, hi, 41)
        k = int(np.argmin(losses(points)))
        lo, hi = points[max(k - 1, 0)], points[min(k + 1, 40)]
    return float(np.exp(points[k]))


def scale(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF values: logarithmic counts over the root of the text's n-grams, times the inverse document frequency."""
    return np.log1p(counts) / np.sqrt(max(counts.sum(), 1.0)) * idf


def rarity(values: np.ndarray, idf: np.ndarray) -> float:
    """Mean inverse document frequency of a text's n-grams, each weighed by its logarithmic count."""
    return float(values.sum() / max((values / idf).sum(), 1e-12))


def deal(labelled: DataFrame, counts: DataFrame, blocks: int, languages: int) -> DataFrame:
    """``block, place, text, lang, alone`` of every labelled row, by hash; rows of a rare language stand in several blocks."""
    least = max(1, min(LEAST_ROWS, BLOCK_ROWS // languages))
    copies = F.least(F.ceil(F.lit(float(least * blocks)) / F.col("n")), F.lit(blocks)).cast("int")
    # ids may repeat, so the text breaks ties; equal rows are interchangeable
    place = F.xxhash64("doc_id", "text")
    rows = labelled.join(counts.select("lang", copies.alias("copies")), "lang").select(place.alias("place"), "text", "lang", "copies")
    block = F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda i: F.pmod(F.xxhash64("place") + i, F.lit(blocks)))
    return rows.select(F.explode(block).alias("block"), "place", "text", "lang", (F.col("copies") == 1).alias("alone"))


class _Block:
    """Features of the rows of one block in the task that fits it: in memory up to ``KEEP_BYTES``, else in a temporary file."""

    def __init__(self):
        self._file = tempfile.SpooledTemporaryFile(KEEP_BYTES)
        self.fitted = 0

    def add(self, label: int, text: str) -> None:
        at, times = bucket_counts(text)
        self._file.write(struct.pack("<qq", label, len(at)) + at.astype("<u4").tobytes() + times.astype("<u4").tobytes())
        self.fitted += 1

    def _rows(self, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        self._file.seek(0)
        while head := self._file.read(16):
            label, n = struct.unpack("<qq", head)
            at = np.frombuffer(self._file.read(4 * n), "<u4").astype(np.int64)
            yield at, scale(np.frombuffer(self._file.read(4 * n), "<u4").astype(float), idf[at]), label

    def fit(self, idf: np.ndarray, classes: int) -> np.ndarray:
        """Weights and, as last row, bias."""
        epochs = min(EPOCHS, -(-STEPS // max(self.fitted, 1)))
        weights, bias = fit_ftrl(lambda: self._rows(idf), classes, BUCKETS, epochs)
        self._file.close()
        return np.vstack([weights, bias])


_FITTED = "cell long, units long, label long, at binary, times binary"


def _fit_blocks(languages: list[str], shared_idf) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``mapInArrow`` body over rows sorted by block and place: the summed weights of the task's blocks, and the features of every
    fifth row, which is held back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {name: i for i, name in enumerate(languages)}
        block, own, units, n = None, None, None, 0
        for batch in batches:
            held = []
            for key, text, lang, alone in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if key != block:
                    if own is not None:
                        found = np.rint(own.fit(shared_idf.value, len(languages)) / UNIT).astype(np.int64)
                        units = found if units is None else units + found
                    block, own, n = key, _Block(), 0
                if n % 5 == 4 and alone:
                    at, times = bucket_counts(text)
                    held.append((number[lang], at.astype("<u4").tobytes(), times.astype("<u4").tobytes()))
                else:
                    own.add(number[lang], text)
                n += alone
            if held:
                label, at, times = zip(*held)
                none = pa.nulls(len(held), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(label, pa.int64()), pa.array(at, pa.binary()), pa.array(times, pa.binary())], ["cell", "units", "label", "at", "times"])
        if own is not None:
            found = np.rint(own.fit(shared_idf.value, len(languages)) / UNIT).astype(np.int64)
            units = (found if units is None else units + found).ravel()
            cells = np.flatnonzero(units)
            none = pa.nulls(len(cells), pa.int64()), *[pa.nulls(len(cells), pa.binary())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(units[cells]), *none], ["cell", "units", "label", "at", "times"])

    return run


def train(rows: DataFrame) -> "Model | None":
    """Model from the columns ``doc_id, text, lang``; None if no row has both a text and a language.

    Every labelled row counts. Document frequencies are sums over the rows. The weights are the mean of
    those that follow-the-regularised-leader finds on each block of :func:`deal`; up to about 1.5 times ``BLOCK_ROWS``
    rows are one block, hence one sequential run. Every fifth row of a block is held back; all of
    these give the temperature and the limits of an accepted text. The model knows every
    label; its weights take ``BUCKETS`` numbers a label, three times that in the task that fits a block.
    """
    labelled = rows.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    counts = settle(labelled.groupBy("lang").agg(F.count("*").alias("n")))  # a row per language, joined by its measured size
    languages = [r["lang"] for r in counts.select("lang").orderBy("lang").collect()]
    if not languages:
        return None
    frequency, total = document_frequencies(labelled)
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 1.0
    blocks = max(1, round(total / BLOCK_ROWS))
    context = rows.sparkSession.sparkContext
    dealt = deal(labelled, counts, blocks, len(languages)).repartition(4 * blocks if blocks > 1 else 1, "block")
    ordered = dealt.sortWithinPartitions("block", "place", "lang", F.xxhash64("text")).select("block", "text", "lang", "alone")
    fitted = settle(ordered.mapInArrow(_fit_blocks(languages, context.broadcast(idf)), _FITTED))
    sums = fitted.where("cell is not null").groupBy("cell").agg(F.sum("units").alias("units")).toArrow()
    mean = np.zeros((BUCKETS + 1) * len(languages), dtype=np.float32)
    mean[sums["cell"].to_numpy()] = sums["units"].to_numpy() * (UNIT / blocks)
    mean = mean.reshape(BUCKETS + 1, len(languages))
    model = Model(languages, mean[:-1], idf, mean[-1], 1.0)
    return _calibrated(model, fitted.where("cell is null"))


def _calibrated(model: Model, held_back: DataFrame) -> Model:
    """The model with the temperature of least log loss and the limits that all rows ``label, at, times`` give."""
    shared = held_back.sparkSession.sparkContext.broadcast(model)

    def judge(rows: pa.RecordBatch) -> pa.RecordBatch:
        m, logits, rare = shared.value, [], []
        for a, t in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist()):
            at = np.frombuffer(a, "<u4").astype(np.int64)
            values = scale(np.frombuffer(t, "<u4").astype(float), m.idf[at])
            logits.append((values @ m.weights[at] + m.bias).astype("<f8").tobytes())
            rare.append(rarity(values, m.idf[at]))
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(logits, pa.binary()), pa.array(rare, pa.float64())], ["label", "logits", "rare"])

    judged = settle(held_back.select("label", "at", "times").mapInArrow(row_mapper(judge), "label long, logits binary, rare double"))
    n = judged.count()
    if not n:
        return model

    def losses(log_t: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(len(log_t))
            for rows in batches:
                label, x = rows.column(0).to_numpy(), _stacked(rows.column(1))
                for k, t in enumerate(log_t):
                    sums[k] -= np.log(np.maximum(softmax(x / np.exp(t))[np.arange(len(label)), label], 1e-12)).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(log_t))), pa.array(sums)], ["k", "loss"])

        found = judged.select("label", "logits").mapInArrow(add, "k long, loss double").groupBy("k").agg(F.sum("loss").alias("loss")).collect()
        return np.array([r["loss"] for r in sorted(found, key=lambda r: r["k"])]) / n + 1e-4 * log_t * log_t

    model.temperature = temperature = fit_temperature(losses)

    def best(rows: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(softmax(_stacked(rows.column(0)) / temperature).max(axis=1)), rows.column(1)], ["best", "rare"])

    scores = judged.select("logits", "rare").mapInArrow(row_mapper(best), "best double, rare double").withColumn("all", F.lit(0))
    low = group_quantiles(scores, ["all"], "best", {"q": REJECTED_SHARE}, n).first()["q"]
    high = group_quantiles(scores, ["all"], "rare", {"q": 1 - REJECTED_SHARE}, n).first()["q"]
    model.least_score, model.most_rarity = min(HIGHEST_LIMIT, low), RARITY_MARGIN * high
    return model


def _stacked(column: pa.Array) -> np.ndarray:
    return np.array([np.frombuffer(x, "<f8") for x in column.to_pylist()])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rarity`` of each row's whole text.

    Null texts and texts without a letter, or a missing model, give ``und``, 0 and null. Other columns stay
    as they are; columns of these three names are replaced. Each row is handled by itself: repeated
    rows get equal results, of equally likely languages the first by name is given, and an empty
    table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(column: pd.Series) -> pd.DataFrame:
        return _label(column, shared.value)

    found = F.pandas_udf(label, "lang_pred string, score double, rarity double")(F.coalesce(F.col("text").cast("string"), F.lit("")))
    names = [F.col(c) for c in docs.columns if c.lower() not in ("lang_pred", "score", "rarity")]
    return docs.select(F.struct(*names).alias("row"), found.alias("found")).select("row.*", "found.*")


def _label(column: pd.Series, model: Model | None) -> pd.DataFrame:
    found = []
    for text in column:
        if model is None or not _LETTER.search(text):
            found.append((UNDETERMINED, 0.0, None))
            continue
        at, counts = bucket_counts(text)
        values = scale(counts, model.idf[at])
        p = softmax((values @ model.weights[at] + model.bias) / model.temperature)
        best = int(p.argmax())
        found.append((model.languages[best], float(p[best]), rarity(values, model.idf[at])))
    names, scores, rare = zip(*found) if found else ((), (), ())
    return pd.DataFrame({"lang_pred": pd.Series(names, dtype="object"), "score": pd.Series(scores, dtype="float64"), "rarity": pd.Series(rare, dtype="float64")})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def accepted(docs: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``docs`` in one of ``languages`` (by default all that the labels name), by the fitted model; the columns stay.

    A text goes if it has no letter, if its predicted language is not wanted, or if it is unlike the
    labelled texts by limits that only a share of ``REJECTED_SHARE`` of held-back rows misses: its calibrated score is
    below ``Model.least_score`` (``HIGHEST_LIMIT`` at most), or its n-grams are rarer than ``Model.most_rarity``
    (the limit times ``RARITY_MARGIN``). Without a usable label no language
    can be ruled out, and all texts with a letter stay. Repeated rows share one fate; an empty table
    stays empty.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    if model is None:
        return docs.where(F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)))
    marked = predict(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), model)
    wanted = (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= model.least_score) & (F.col("rarity") <= model.most_rarity)
    if languages is not None:
        wanted &= F.col("lang_pred").isin(list(languages))
    return marked.where(wanted).select("row.*")
