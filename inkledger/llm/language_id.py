"""Language identification by error-correcting output codes.

Every learned language has a codeword. For each bit a binary classifier on
hashed byte trigrams tells the languages with 1 there from those with 0:
regularized least squares, whose leave-one-out margins come for nothing. They
give each bit's weight (how often it is right) and the scale of the scores.
A text gets the language whose codeword has the least weighted loss over the
bits; ``score`` is its share of the likelihood, and ``ambiguous`` marks texts
whose two nearest codewords are about as near.

The classifiers are fitted on a bounded sample of labelled documents, about
``PER_LANGUAGE`` of a language and ``SAMPLE`` in all, but for languages of which
that leaves fewer than ``LEAST``: picked by a hash among all that may be learned
from; of those, whole texts count. Every language that occurs gets a codeword,
as one that is as long as their number asks for; the driver holds a row for each.
Every text is read whole.

Edge cases: a text that is null or has no letter is ``und``, score 0, and so is
any text if nothing can be learned; with one language learned, that is every
text's; documents with a null id are predicted and not learned from; repeated
rows stay; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.llm.shared import discard, give_back, materialize

NONE = "und"
#: Documents that the classifiers are fitted on.
SAMPLE = 4000
PER_LANGUAGE = 400
#: Documents of a language, if it has so many, however many languages there are.
LEAST = 12
#: Hashed trigrams.
BUCKETS = 1 << 13
RIDGE = 0.05
#: A second codeword that has this share of the first one's likelihood or more makes a text ambiguous.
AMBIGUOUS = 0.8
#: Bytes of a text looked at at a time, and texts that are predicted together.
SLICE = 1 << 20
TEXTS = 128

_SPACES = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN.search(text) is not None or any(map(str.isalpha, text)))


def features(text: str) -> np.ndarray:
    """Square roots of the trigrams' frequencies, over the whole text; of length 1."""
    data = b" ".join((" " + text.lower() + " ").encode().translate(_SPACES).split())
    data = np.frombuffer(b" " + data + b" ", dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.float64)
    for k in range(0, max(1, len(data) - 2), SLICE):
        part = data[k : k + SLICE + 2].astype(np.uint32)
        code = part[:-2] << 16 | part[1:-1] << 8 | part[2:]
        code *= np.uint32(0x9E3779B1)
        counts += np.bincount(code >> np.uint32(32 - 13), minlength=BUCKETS)
    return np.sqrt(counts / max(1.0, counts.sum())).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A codeword of -1 and 1 for each of ``n`` classes: all splits of up to 7 classes, else the best of random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        splits = np.arange(1, 1 << (n - 1))
        return np.where(splits >> np.arange(n)[:, None] & 1, 1.0, -1.0)
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(n)))
    best, distance = None, -1.0
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1  # a bit that is the same for all tells nothing
        near = (bits - (code @ code.T - bits * 2 * np.eye(n)).max()) / 2
        if near > distance:
            best, distance = code, near
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # bucket x bit
    mean: np.ndarray
    bias: np.ndarray
    trust: np.ndarray  # of a bit
    scale: float

    def likelihood(self, margins: np.ndarray) -> np.ndarray:
        """Each language's share, from the bits' margins (text x bit)."""
        return _share(margins, self.code, self.trust, self.scale)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, share and ambiguity of each row of features."""
        share = self.likelihood((x - self.mean) @ self.weights + self.bias)
        best = share.argmax(axis=1)
        top = share[np.arange(len(x)), best]
        second = np.sort(share, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(x))
        return best, top, second >= AMBIGUOUS * top


def _share(margins: np.ndarray, code: np.ndarray, trust: np.ndarray, scale: float) -> np.ndarray:
    loss = np.logaddexp(0, -2 * margins[:, None, :] * code[None]) @ trust
    likely = np.exp(-scale * (loss - loss.min(axis=1, keepdims=True)))
    return likely / likely.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    languages = sorted(set(langs))
    if not languages:
        return None
    y = np.array([languages.index(v) for v in langs])
    code = codewords(len(languages))
    target = code[y]
    mean = x.mean(axis=0)
    centered = (x - mean).astype(np.float64)
    bias = target.mean(axis=0)
    inverse = np.linalg.inv(centered @ centered.T + RIDGE * np.eye(len(x)))
    dual = inverse @ (target - bias)
    left_out = target - dual / np.diag(inverse)[:, None]
    right = (np.sign(left_out) == target).mean(axis=0)
    trust = np.maximum(2 * right - 1, 0.01)
    trust /= trust.sum()
    scales = [2.0**k for k in range(-1, 9)]
    fits = [np.log(np.maximum(_share(left_out, code, trust, s)[np.arange(len(y)), y], 1e-9)).mean() for s in scales]
    return Model(languages, code, (centered.T @ dual).astype(np.float32), mean.astype(np.float32), bias, trust, scales[int(np.argmax(fits))])


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits on the bounded sample of the documents that may be learned from."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    # Written first, so that its size is known: Spark broadcasts it, and no text is shuffled.
    counts = materialize(rows.groupBy(F.col(lang_col).alias("lang")).count(), "languages")
    languages = counts.count()
    if not languages:
        return None
    most = min(PER_LANGUAGE, max(LEAST, SAMPLE // languages))
    # A hash picks about ``most`` of each language.
    shares = counts.select("lang", (F.least(F.lit(1.0), most / F.col("count")) * (1 << 30)).cast("long").alias("share"))
    picked = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)).alias("h"))
    picked = picked.join(shares, "lang").where(F.col("h") < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if has_letter(text := text.as_py()):
                    x = features(text)
                    at = np.flatnonzero(x)
                    yield pa.record_batch({"lang": [lang], "at": [at.astype(np.int32)], "x": [x[at]]}, schema=pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))]))

    sample = picked.mapInArrow(run, "lang string, at array<int>, x array<float>").toArrow()
    discard(docs.sparkSession, counts)
    sample = sample.sort_by("lang")
    x = np.zeros((sample.num_rows, BUCKETS), dtype=np.float32)
    for k, (at, v) in enumerate(zip(sample.column("at"), sample.column("x"), strict=True)):
        x[k, at.values.to_numpy()] = v.values.to_numpy()
    return fit(x, sample.column("lang").to_pylist())


def _predict(model: Model | None, texts: pa.Array) -> tuple[list, list, list]:
    """Language, share and ambiguity of each text; ``TEXTS`` of them share a product."""
    n = len(texts)
    langs, scores, unsure = [NONE] * n, [0.0] * n, [False] * n
    if model is None:
        return langs, scores, unsure
    for start in range(0, n, TEXTS):
        rows = [(k, t) for k in range(start, min(start + TEXTS, n)) if has_letter(t := texts[k].as_py())]
        if not rows:
            continue
        best, top, near = model.predict(np.stack([features(t) for _, t in rows]))
        for (k, _), b, s, u in zip(rows, best.tolist(), top.tolist(), near.tolist(), strict=True):
            langs[k], scores[k], unsure[k] = model.languages[b], s, u
    return langs, scores, unsure


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, unsure = _predict(model.value, batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose language can't be told: no letter, or ambiguous."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, id_col, text_col, lang_col))
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, unsure = _predict(model.value, batch.column(place))
            yield batch.filter(pa.array([lang != NONE and not u for lang, u in zip(langs, unsure, strict=True)], pa.bool_()))
            give_back()

    return docs.mapInArrow(run, docs.schema)
