"""Toxic passages: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated as extreme values."""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barledger.llm.common import row_mapper, settle, texts

#: Labelled rows that the classifier is fitted on, chosen by the hash of their id.
SAMPLE_ROWS = 40_000
#: A token counts by its word; words that are not in the lexicon count by their first letters.
PREFIXES = (4, 5, 6)
#: Mass of the Dirichlet prior, spread by how common a token is in the sample.
PRIOR_MASS = 50.0
#: Least z-score and log-odds of a token in the lexicon, and least toxic texts that hold it.
MIN_Z = 3.0
MIN_SCORE = 2.0
MIN_TEXTS = 3
#: A passage is significant if fewer than this many are expected by chance in its text.
MAX_EXPECTED = 0.5
#: Most log-odds of a text without a significant passage.
NO_EVIDENCE = -0.04
#: Runs of letters of scripts without spaces (Han, kana, Thai, Lao, Tibetan, Myanmar, Khmer) are cut into overlapping pieces of so many characters.
GRAM = 2
SPACELESS = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: Sample rows per task.
TASK_ROWS = 500
_TOKEN = re.compile(rf"[{SPACELESS}]+|[^\W\d_{SPACELESS}]+")
_SPACELESS = re.compile(f"[{SPACELESS}]")


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    heads: set[str] = field(default_factory=set)  # first letters of all of them
    other: float = -0.05  # score of any other token
    decay: float = 1.0  # lambda of the extreme-value law
    scale: float = 1.0  # K of the extreme-value law
    slope: float = 0.0
    offset: float = -1.0


def tokens(text: str) -> list[str]:
    """Runs of letters in lower case, those of scripts without spaces in overlapping pieces."""
    runs = _TOKEN.findall(text.lower())
    if text.isascii() or not _SPACELESS.search(text):
        return runs
    out: list[str] = []
    for run in runs:
        out.extend([run[i:i + GRAM] for i in range(max(1, len(run) - GRAM + 1))] if _SPACELESS.match(run) else [run])
    return out


def hit(word: str, lexicon: Lexicon) -> float:
    """Score of a token; 0 if neither it nor its first letters are in the lexicon."""
    if word[:PREFIXES[0]] not in lexicon.heads:
        return 0.0
    score = lexicon.words.get(word)
    if score is None:
        score = max((lexicon.prefixes.get(word[:n], 0.0) for n in PREFIXES if len(word) > n), default=0.0)
    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``text, toxic`` of up to ``rows`` labelled rows, by the hash of their id; the ids go to the tasks, and the different texts of the sample are dealt evenly."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").select("doc_id", "toxic")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    found = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    distinct = found.dropDuplicates(["text", "toxic"])  # copies say nothing new
    return distinct.repartition(max(8, -(-rows // TASK_ROWS)), F.xxhash64("text"))


def token_texts(rows: DataFrame) -> DataFrame:
    """``token, toxic, clean``: texts of either label that hold a token; ``^`` begins a prefix, the empty token counts all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist()):
                words = set(tokens(text))
                sums[toxic].update(words)
                sums[toxic].update({f"^{w[:n]}" for w in words for n in PREFIXES if len(w) > n})
                sums[toxic][""] += 1
        names = list(sums[0].keys() | sums[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *[pa.array([s[t] for t in names], pa.int64()) for s in (sums[1], sums[0])]], ["token", "toxic", "clean"])

    parts = rows.select("text", F.col("toxic").cast("int")).mapInArrow(count, "token string, toxic long, clean long")
    return parts.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def significant(counts: DataFrame, toxic_texts: int, clean_texts: int) -> DataFrame:
    """``token, score``: log-odds of the tokens that mark toxic texts.

    The prior of a token is its share of all sample texts times ``PRIOR_MASS``; its odds among toxic
    and clean texts are compared with that prior added to both.
    """
    share = (F.col("toxic") + F.col("clean")) / float(max(toxic_texts + clean_texts, 1))
    prior = PRIOR_MASS * share

    def odds(seen: Column, texts_of: int) -> Column:
        return F.log((seen + prior) / (texts_of + PRIOR_MASS - seen - prior + 1.0))

    delta = odds(F.col("toxic"), toxic_texts) - odds(F.col("clean"), clean_texts)
    spread = F.sqrt(1.0 / (F.col("toxic") + prior) + 1.0 / (F.col("clean") + prior))
    scored = counts.where((F.col("token") != "") & (F.col("toxic") >= MIN_TEXTS)).select("token", delta.alias("score"), (delta / spread).alias("z"))
    return scored.where((F.col("z") >= MIN_Z) & (F.col("score") >= MIN_SCORE)).select("token", "score")


def segments(places: list[int], scores: list[float], length: int, other: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first token, end) of a text of ``length`` tokens, in linear time.

    ``places`` and ``scores`` are the tokens with positive scores; every other token has the score
    ``other`` < 0, so only those between hits count. Each hit starts a candidate, which merges with
    an earlier one as long as that makes a larger sum.
    """
    found: list[list[float]] = []  # first token, end, sum before it, sum at its end
    total, last = 0.0, 0
    for place, score in zip(places, scores):
        total += (place - last) * other
        candidate = [place, place + 1, total, total + score]
        total += score
        last = place + 1
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= candidate[2]:
                k -= 1
            if k < 0 or found[k][3] >= candidate[3]:
                found.append(candidate)
                break
            candidate = [found[k][0], candidate[1], found[k][2], candidate[3]]
            del found[k:]
    return [(f[3] - f[2], int(f[0]), int(f[1])) for f in found]


def passages(text: str, lexicon: Lexicon) -> list[tuple[float, int, int, float]]:
    """Significant passages: (score, first token, end, texts of that length in which one as high is expected by chance)."""
    words = tokens(text)
    places, scores = [], []
    heads, head = lexicon.heads, PREFIXES[0]
    for i, w in enumerate(words):
        if w[:head] in heads and (score := hit(w, lexicon)):
            places.append(i)
            scores.append(score)
    if not places:
        return []
    out = []
    for score, start, end in segments(places, scores, len(words), lexicon.other):
        expected = lexicon.scale * len(words) * float(np.exp(-lexicon.decay * score))
        if expected <= MAX_EXPECTED:
            out.append((score, start, end, expected))
    return out


def evidence(text: str, lexicon: Lexicon) -> float:
    """Sum of the significance (minus log of the expected number) of all significant passages, at most 60."""
    return min(60.0, sum(-float(np.log(max(e, 1e-26))) for *_, e in passages(text, lexicon)))


def fit_law(hits: dict[float, int], others: int, other: float) -> tuple[float, float]:
    """lambda and K of the chance law of segment scores: lambda solves mean(exp(lambda * score)) = 1 over clean tokens.

    All hits together count as seen once more than they were, so that clean texts without any hit
    still give a finite law.
    """
    seen = {s: n + 1.0 / len(hits) for s, n in hits.items()} or {5.0: 1.0}
    total = others + sum(seen.values())

    def mean(x: float) -> float:
        return (others * np.exp(x * other) + sum(n * np.exp(min(x * s, 600.0)) for s, n in seen.items())) / total

    lo, hi = 1e-6, 1.0
    while mean(hi) < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if mean(mid) < 1 else (lo, mid)
    drift = (others * other + sum(n * s for s, n in seen.items())) / total
    return lo, float(min(1.0, max(1e-3, abs(drift) * lo)))


def fit_logistic(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """slope, offset of the share of toxic rows over ``x``, by Newton steps on counts."""
    design = np.column_stack([x, np.ones_like(x)])
    w = np.zeros(2)
    n = toxic + clean
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (toxic - n * p) - ridge * w
        hessian = design.T @ (design * (n * p * (1 - p))[:, None]) + ridge * np.eye(2)
        w += np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(w[0]), float(w[1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Lexicon:
    """Lexicon, chance law and calibration from labelled rows.

    Everything is counted in tasks over a sample bounded by ``rows``; the driver gets the significant
    tokens (``MIN_Z`` and ``MIN_TEXTS`` bound them by the sample) and histograms. Without labels, with
    one kind only, or if no token marks toxic texts, every score is low; so is that of any text without a significant passage.
    """
    sample = settle(labelled(docs, labels, rows))
    counts = settle(token_texts(sample))
    whole = counts.where("token = ''").agg(F.sum("toxic"), F.sum("clean")).first()
    toxic_texts, clean_texts = int(whole[0] or 0), int(whole[1] or 0)
    if not toxic_texts or not clean_texts:
        return Lexicon()
    found = {r["token"]: r["score"] for r in significant(counts, toxic_texts, clean_texts).collect()}
    if not found:
        return Lexicon()
    lexicon = Lexicon({t: s for t, s in found.items() if t[0] != "^"}, {t[1:]: s for t, s in found.items() if t[0] == "^"})
    lexicon.heads = {t.lstrip("^")[:PREFIXES[0]] for t in found}
    hits, others, toxic_share = _token_scores(sample, lexicon)
    lexicon.other = float(np.log((1 - toxic_share[1]) / (1 - toxic_share[0]))) if toxic_share[1] > toxic_share[0] else -0.02
    lexicon.other = float(np.clip(lexicon.other, -1.0, -0.01))
    lexicon.decay, lexicon.scale = fit_law(hits, others, lexicon.other)
    table = _evidence_counts(sample, lexicon)
    slope, offset = fit_logistic(table[:, 0], table[:, 1], table[:, 2])
    lexicon.slope, lexicon.offset = max(slope, 0.0), min(offset, NO_EVIDENCE)
    return lexicon


def _token_scores(sample: DataFrame, lexicon: Lexicon) -> tuple[dict[float, int], int, tuple[float, float]]:
    """Scores of the hits of clean texts and how often, their other tokens, and the share of hits in clean and in toxic texts."""

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        sums: Counter = Counter()
        for text, toxic in zip(texts(rows.column(0)), rows.column(1).to_pylist()):
            for w, n in Counter(tokens(text)).items():
                sums[toxic, round(hit(w, lexicon), 2)] += n
        keys = list(sums)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.float64()), pa.array([sums[k] for k in keys], pa.int64())], ["toxic", "score", "n"])

    parts = sample.select("text", F.col("toxic").cast("int")).mapInArrow(row_mapper(count), "toxic int, score double, n long")
    sums = {(r["toxic"], r["score"]): r["n"] for r in parts.groupBy("toxic", "score").agg(F.sum("n").alias("n")).collect()}
    hits = {s: 0 for t, s in sums if s > 0} | {s: n for (t, s), n in sums.items() if t == 0 and s > 0}
    share = []
    for label in (0, 1):
        every = sum(n for (t, _), n in sums.items() if t == label)
        share.append(sum(n for (t, s), n in sums.items() if t == label and s > 0) / max(every, 1))
    return hits, sums.get((0, 0.0), 0), (share[0], share[1])


def _evidence_counts(sample: DataFrame, lexicon: Lexicon) -> np.ndarray:
    """Rows of (evidence, toxic texts, clean texts)."""

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = [round(evidence(t, lexicon), 1) for t in texts(rows.column(0))]
        return pa.RecordBatch.from_arrays([pa.array(found, pa.float64()), rows.column(1)], ["x", "toxic"])

    marked = sample.select("text", F.col("toxic").cast("int")).mapInArrow(row_mapper(count), "x double, toxic int")
    sums = marked.groupBy("x").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).collect()
    return np.array([(r["x"], r["toxic"], r["clean"]) for r in sums], dtype=float).reshape(-1, 3)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``passages`` (first token, end, segment score) of the whole texts.

    Null and empty texts have no passage and the score of a text without evidence, which is below one
    half. Other columns stay; columns of these two names are replaced. Each row is handled by itself:
    repeated rows get equal scores, and an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def rate(column: pd.Series) -> pd.DataFrame:
        known = shared.value
        found = [passages(t, known) for t in column]
        x = np.array([min(60.0, sum(-np.log(max(e, 1e-26)) for *_, e in f)) for f in found], dtype=float)
        value = 1 / (1 + np.exp(-np.clip(known.slope * x + known.offset, -30, 30)))
        spans = [[{"start": s, "end": e, "value": v} for v, s, e, _ in f] for f in found]
        return pd.DataFrame({"score": value, "passages": pd.Series(spans, dtype="object")})

    rated = F.pandas_udf(rate, "score double, passages array<struct<start:int,end:int,value:double>>")
    names = [F.col(c) for c in docs.columns if c.lower() not in ("score", "passages")]
    found = docs.select(F.struct(*names).alias("row"), rated(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("rated"))
    return found.select("row.*", "rated.*")
