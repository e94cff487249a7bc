"""Language identification with a string kernel, Nyström landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of distinct 1- to 3-grams both have (blended spectrum, presence only), divided by the root of
the product of their own numbers.  Texts are folded first: lower-cased, every character that is no letter becomes a gap, gaps are one wide.
Grams are kept by code in an alphabet learned from the sample; letters outside it share one code.

The model is fitted on a bounded, documented sample: the ``PER_LANGUAGE`` labelled rows of each language with the smallest hash of
their id.  ``LANDMARKS`` of them span the feature space; a ridge regression for each language is solved there.  Scoring is one matrix
product for each batch: presence rows times the landmark grams, then times the folded weights.  Every text is scored whole.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled row everything is ``und``; equal
texts get equal results; of equal decision values the first language by name wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.llm.common import boxed, slices

PER_LANGUAGE, LANDMARKS, RIDGE = 300, 160, 1e-3
#: Letters of the alphabet: the most frequent ones of the sample.  Code 0 is the gap, the last one is any other letter.
LETTERS = 62
ROWS = 128
UNDECIDED = "und"


@dataclass
class Model:
    languages: list[str]
    letters: dict[int, int]
    grams: np.ndarray
    weights: np.ndarray
    roots: np.ndarray


def fold(text: str, letters: dict[int, int], other: int) -> np.ndarray:
    """Codes of the letters with one gap between words and at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    distinct, where = np.unique(points, return_inverse=True)
    codes = np.array([letters.get(p, other) if chr(p).isalpha() else 0 for p in distinct.tolist()], dtype=np.int64)
    out = np.concatenate([[0], codes[where], [0]])
    return out[np.append(True, (out[1:] != 0) | (out[:-1] != 0))]


def gram_codes(codes: np.ndarray, base: int) -> np.ndarray:
    """The distinct 1-, 2- and 3-grams as numbers below ``table_size(base)``."""
    seen = np.zeros(table_size(base), dtype=bool)
    seen[codes] = True
    pairs = codes[:-1] * base + codes[1:]
    seen[base + pairs] = True
    seen[base + base * base + pairs[:-1] * base + codes[2:]] = True
    return np.flatnonzero(seen)


def table_size(base: int) -> int:
    return base + base**2 + base**3


def fit(rows: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE, letters: int = LETTERS) -> Model | None:
    """``rows``: (language, text) of the sample, in an order that does not depend on how it was gathered."""
    rows = [(lang, text) for lang, text in rows if any(c.isalpha() for c in text)]
    if not rows:
        return None
    points, counts = np.unique(np.concatenate([np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for _, t in rows]), return_counts=True)
    alphabet = [(-n, p) for p, n in zip(points.tolist(), counts.tolist()) if chr(p).isalpha()]
    known = {p: i + 1 for i, (_, p) in enumerate(sorted(alphabet)[:letters])}
    base = letters + 2
    sets = [gram_codes(fold(t, known, letters + 1), base) for _, t in rows]
    languages = sorted({lang for lang, _ in rows})
    # landmarks: every language in turn, in the order of the sample
    ranks: dict[str, int] = {}
    order = []
    for i, (lang, _) in enumerate(rows):
        ranks[lang] = ranks.get(lang, 0) + 1
        order.append((ranks[lang], lang, i))
    chosen = [i for _, _, i in sorted(order)[:landmarks]]
    grams = np.unique(np.concatenate([sets[i] for i in chosen]))
    marks = presence([sets[i] for i in chosen], grams)
    marks /= np.sqrt([len(sets[i]) for i in chosen])[:, None]
    among = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(among)
    good = values > 1e-6 * values[-1]
    roots = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([
        (presence(sets[at:at + ROWS], grams) / np.sqrt([len(s) for s in sets[at:at + ROWS]])[:, None]) @ (marks.T @ roots)
        for at in range(0, len(sets), ROWS)])
    features = np.hstack([features, np.ones((len(features), 1))])
    targets = np.array([[1.0 if lang == wanted else -1.0 for wanted in languages] for lang, _ in rows])
    sizes = {lang: sum(own == lang for own, _ in rows) for lang in languages}
    balance = np.array([1.0 / sizes[lang] for lang, _ in rows])[:, None]
    solved = np.linalg.solve(features.T @ (balance * features) + ridge * np.eye(features.shape[1]), features.T @ (balance * targets))
    return Model(languages, known, grams, (marks.T @ (roots @ solved[:-1])).astype(np.float32), solved[-1])


def presence(sets: list[np.ndarray], grams: np.ndarray) -> np.ndarray:
    """A row for each text, a column for each gram of the landmarks."""
    out = np.zeros((len(sets), len(grams)), dtype=np.float32)
    for row, own in zip(out, sets):
        at = np.searchsorted(grams, own)
        at[at == len(grams)] = 0
        row[at[grams[at] == own]] = 1
    return out


def predict(model: Model, texts: list[str]) -> list[tuple[str, float]]:
    """Language and score (softmax of the decision values) of texts that have a letter."""
    other, base = LETTERS + 1, LETTERS + 2
    sets = [gram_codes(fold(t, model.letters, other), base) for t in texts]
    decided = (presence(sets, model.grams) / np.sqrt([len(s) for s in sets])[:, None]) @ model.weights + model.roots
    likely = np.exp(4 * (decided - decided.max(axis=1, keepdims=True)))
    likely /= likely.sum(axis=1, keepdims=True)
    best = decided.argmax(axis=1)
    return [(model.languages[b], float(p)) for b, p in zip(best.tolist(), likely[np.arange(len(best)), best].tolist())]


def sample(docs: DataFrame, learnable: Column, doc_id: str, text: str, lang: str, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """At most ``per_language`` rows of each language, chosen by a hash of the id: a small list whatever the size of the table.

    The choice is made on ids alone and cut in every task before rows are moved; only the chosen texts are read.
    """
    named = docs.filter(learnable & F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull()).select(
        F.col(f"`{doc_id}`").alias("id"), F.col(f"`{lang}`").alias("lang"), F.xxhash64(f"`{doc_id}`").alias("h"), F.col(f"`{text}`").alias("text"))
    ranked = named.select("id", "lang", "h").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))).filter(F.col("n") <= per_language)
    chosen = ranked.select("id", "lang", "h").distinct()
    rows = named.join(F.broadcast(chosen), ["id", "lang", "h"], "left_semi").select("lang", "h", "text").collect()
    return [(r.lang, r.text) for r in sorted(rows, key=lambda r: (r.lang, r.h, r.text))]


def learn(docs: DataFrame, learnable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """The model of the sample of rows where ``learnable`` holds."""
    return fit(sample(docs, learnable, doc_id, text, lang))


def identify(docs: DataFrame, fitted: Model | None, text: str = "text") -> DataFrame:
    """Struct ``row`` of the input with ``lang_pred`` and ``score``, from the texts alone."""
    model = docs.sparkSession.sparkContext.broadcast(fitted)
    parts = boxed(docs, text=text)
    readable = parts.select("row", F.when(F.col("text").rlike("\\p{L}"), F.col("text")).alias("text"))

    def run(batches):
        for batch in slices(batches, "text"):
            texts = batch.column("text").to_pylist()
            out = [(UNDECIDED, 0.0)] * len(texts)
            if model.value is not None:
                known = [i for i, t in enumerate(texts) if t is not None and any(c.isalpha() for c in t)]
                for at in range(0, len(known), ROWS):
                    part = known[at:at + ROWS]
                    for i, result in zip(part, predict(model.value, [texts[i] for i in part])):
                        out[i] = result
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.float64())], names=["row", "lang_pred", "score"])

    return readable.mapInArrow(run, StructType([readable.schema["row"], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1
