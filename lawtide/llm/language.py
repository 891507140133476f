"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the average of the embeddings of its subwords (runs of 2 to 4 bytes, hashed into buckets);
a softmax over a linear map of that average gives the language. Both are trained by stochastic
gradient descent in numpy on the driver, on a bounded sample of labelled rows. As the average and the map
are linear, prediction needs one table, buckets x languages, which is what tasks receive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawtide.llm.words import slices

UNKNOWN = "und"
SIZES, BUCKET_BITS, DIMENSIONS = (2, 3, 4), 16, 16

#: Bytes as the model sees them: A-Z in lower case, all other ASCII but letters as a space.
_SEEN = np.array([b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)], np.uint32)


def _subwords(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each subword size: the bucket at every byte, and where each text's begin."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = _SEEN[np.frombuffer(held, np.uint8)[offsets[0]: offsets[-1]]] if held is not None else np.zeros(0, np.uint32)
    offsets = offsets - offsets[0]
    for n in SIZES:
        code = np.zeros(max(0, len(data) - n + 1), np.uint32)
        for i in range(n):
            code = code * np.uint32(0x01000193) + data[i: i + len(code)]
        bucket = (code + np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)
        counts = np.maximum(0, np.diff(offsets) - n + 1)
        first = np.append(0, np.cumsum(counts))
        at = np.repeat(offsets[:-1] - first[:-1], counts) + np.arange(first[-1])
        yield bucket[at], first


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether a text has a letter of any script; null has none."""
    ascii_ = pc.fill_null(pc.match_substring_regex(texts, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
    beyond = pc.fill_null(pc.match_substring_regex(texts, "[^\\x00-\\x7F]"), False).to_numpy(zero_copy_only=False)
    out = ascii_.copy()
    for i in np.flatnonzero(beyond & ~ascii_):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


@dataclass
class Model:
    """languages; table: what each bucket adds to a language's logit, before averaging."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    reject_below: float

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1: none) and score of every text."""
        sums = np.zeros((len(self.languages), len(texts)))
        total = np.zeros(len(texts))
        for bucket, first in _subwords(texts):
            some = np.flatnonzero(np.diff(first))
            total += np.diff(first)
            if len(some):
                for i, column in enumerate(self.table.T):
                    sums[i, some] += np.add.reduceat(column[bucket], first[:-1][some], dtype=np.float64)
        logits = sums / np.maximum(total, 1) + self.bias[:, None]
        p = _softmax(logits.T / self.temperature)
        best = p.argmax(axis=1)
        there = has_letter(texts)
        return np.where(there, best, -1), np.where(there, p[np.arange(len(best)), best], 0.0)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _drawn(n: int):
    """A fixed number of subwords of each text, drawn from the whole of it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, cells = [], []
            for i in range(batch.num_rows):
                found = np.concatenate([b for b, _ in _subwords(batch["text"].slice(i, 1))])
                keep.append(len(found) > 0)
                if len(found):
                    pick = np.random.default_rng(len(found)).integers(0, len(found), n)
                    cells.append(found[pick].astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch["lang"].filter(pa.array(keep)), batch["key"].filter(pa.array(keep)),
                 pa.array(cells, pa.binary())], ["lang", "key", "cell"])
    return run


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *,
    rows_per_language: int = 1000, subwords: int = 512, epochs: int = 8, rate: float = 0.5, seed: int = 1,
    accepted_share: float = 0.999, short_subwords: int = 24,
) -> Model | None:
    """Fits a model on rows with a language that are not held out; None where there are none.

    Of each language about `rows_per_language` rows are taken, by a hash of id and text (all rows if there
    are fewer), and of each row `subwords` places of its whole text; that bounds what the driver gets. A
    fifth of the sample is set aside to fit the temperature of the scores, so that scores of texts of
    `short_subwords` subwords are the share of right predictions, and the threshold under which a
    prediction is rejected: half the score that `accepted_share` of the rows predicted right reach.
    """
    labelled = docs.select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(id_col), F.col(text_col).cast("string")).alias("key"),
        held_out(F.col(id_col)).alias("held_out"), F.col(id_col).alias("id"),
    ).where("lang IS NOT NULL AND NOT held_out AND id IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, rows_per_language / n))])
    taken = labelled.where(F.pmod("key", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    rows = taken.select("lang", "key", "text").mapInArrow(
        _drawn(subwords), "lang string, key long, cell binary").collect()
    rows.sort(key=lambda r: (r["key"], r["lang"], bytes(r["cell"])))
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    x = np.array([np.frombuffer(r["cell"], np.uint16) for r in rows]).astype(np.int64)
    y = np.array([languages.index(r["lang"]) for r in rows])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    aside = order[: max(1, len(rows) // 5)]
    fit = order[len(aside):] if len(rows) > 1 else order
    embeddings = (rng.random((1 << BUCKET_BITS, DIMENSIONS)) - 0.5) / DIMENSIONS
    weights, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps = max(1, epochs * len(fit) // 16)
    for step in range(steps):
        batch = rng.choice(fit, 16)
        lr = rate * (1 - step / steps)
        own = x[batch]
        mean = embeddings[own].mean(axis=1)
        error = _softmax(mean @ weights + bias)
        error[np.arange(len(batch)), y[batch]] -= 1
        back = error @ weights.T / own.shape[1]
        weights -= lr * mean.T @ error
        bias -= lr * error.mean(axis=0)
        np.subtract.at(embeddings, own.ravel(), np.repeat(lr * 8 * back, own.shape[1], axis=0))
    table = (embeddings @ weights).astype(np.float32)
    short = table[x[aside][:, :short_subwords]].mean(axis=1, dtype=np.float64) + bias
    logits = table[x[aside]].mean(axis=1, dtype=np.float64) + bias

    def loss(t: float) -> float:
        p = _softmax(short / t)[np.arange(len(aside)), y[aside]]
        return -np.log(np.maximum(p, 1e-12)).mean()

    temperature = min(np.geomspace(0.02, 5, 60), key=loss)
    p = _softmax(logits / temperature)
    right = p.argmax(axis=1) == y[aside]
    sure = p.max(axis=1)[right]
    reject = float(np.quantile(sure, 1 - accepted_share)) / 2 if len(sure) else 0.0
    return Model(languages, table, bias, float(temperature), min(reject, 0.5))


def _identified(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                if model is None:
                    best, score = np.full(b - a, -1), np.zeros(b - a)
                else:
                    best, score = model.predict(part["text"])
                names = [UNKNOWN if i < 0 else model.languages[i] for i in best.tolist()]
                accepted = (best >= 0) & (score >= (model.reject_below if model else 0))
                yield pa.RecordBatch.from_arrays(
                    [part["row"], pa.array(names, pa.string()), pa.array(score), pa.array(accepted)],
                    ["row", "lang_pred", "score", "accepted"])
    return run


def identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs as the column `row`, with lang_pred, score (0 to 1), accepted.

    The whole text is read, whatever its length. lang_pred is a learned language, or "und" with score 0
    where the text is null or has no letter (and for all rows where no model could be learned); accepted
    says that it is a language and the score reaches the model's threshold. Other columns are
    carried along unread, inside `row`.
    """
    source = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = source.select("row").withColumns({
        "lang_pred": F.lit(""), "score": F.lit(0.0), "accepted": F.lit(False)}).schema
    return source.mapInArrow(_identified(sent), schema)
