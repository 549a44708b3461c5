"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters (lower case, all but letters as one blank) are hashed to DIMS dimensions. Document
frequencies are counted over all labelled documents. The weights are learned by follow-the-regularised-leader with an
elastic-net penalty from a bounded sample of labelled documents, about SAMPLE_PER_LANG for each language, chosen by a
hash of id and text, rows that agree in both counting once; a fifth of the sample is kept from learning, and on it the
temperature that divides the logits is fitted. The one task that trains reads the sample as a stream, once for each epoch,
so that it holds the weights and no documents. Prediction reads every whole text, very long ones window by window.

Defined results: a text that is null or has no letter is `und` with score 0; without any labelled document every text is.
Null labels aren't learned from. A null id counts as the empty string when folds are dealt. Repeated rows get equal
results; an empty table gives an empty one. Only doc_id, text and (to learn) lang are read.
"""

from __future__ import annotations

import pickle
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

DIMS = 1 << 16
ORDERS = (1, 2, 3)
SAMPLE_PER_LANG = 1000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 0.05
#: Code points that are hashed at once.
WINDOW = 1 << 20
#: The pipeline drops documents of no language, and those whose likeliest language has less than this many times the
#: probability of a guess, 1 in as many as there are languages.
LEAST_OF_GUESS = 1.2


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def counts(text: str) -> np.ndarray | None:
    """How often each dimension occurs in a text; None if it has no letter."""
    s = text.lower()
    out, any_letter = np.zeros(DIMS, np.int64), False
    for at in range(0, len(s), WINDOW):
        code = np.frombuffer(s[at : at + WINDOW + max(ORDERS) - 1].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[code]
        any_letter |= bool(letter.any())
        code = np.where(letter, code, 32).astype(np.uint32)
        for n in ORDERS:
            m = min(WINDOW, len(code) - n + 1)
            if m <= 0:
                continue
            h = code[:m] * np.uint32(0x9E3779B1) + np.uint32(n)
            some = letter[:m].copy()
            for j in range(1, n):
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) + code[j : j + m] * np.uint32(0xC2B2AE35)
                some |= letter[j : j + m]
            h ^= h >> np.uint32(16)
            h *= np.uint32(0x7FEB352D)
            out += np.bincount((h >> np.uint32(16))[some], minlength=DIMS)
    return out if any_letter else None


def features(c: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and values of a document: (1 + log tf) * idf, of length 1."""
    at = np.flatnonzero(c)
    x = (1 + np.log(c[at])) * idf[at]
    return at, x / np.sqrt(x @ x)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


class Ftrl:
    """Multinomial FTRL-proximal: per coordinate and class, z gathers gradients and n their squares; a weight is 0 until
    |z| passes L1."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))  # the last row is the intercept

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, DIMS), np.append(x, 1.0)
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def temperature(logits: list[np.ndarray], labels: list[int]) -> float:
    """The divisor of the logits under which the labels are most likely, by golden section over its logarithm. Labels
    count as right up to one error in n + 2, as in Platt's scaling: without an error in n documents the likeliest divisor
    would be 0, and every score 1."""
    if not labels or len(logits[0]) < 2:
        return 1.0
    z, y = np.array(logits), np.array(labels)
    wrong = 1 / (len(y) + 2)
    want = np.full(z.shape, wrong / (z.shape[1] - 1))
    want[np.arange(len(y)), y] = 1 - wrong

    def loss(t: float) -> float:
        s = z / np.exp(t)
        s = s - s.max(1, keepdims=True)
        return float((np.log(np.exp(s).sum(1)) - (want * s).sum(1)).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def fold(doc_id: Column) -> Column:
    """0 to 3; documents of fold 2 are held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def _frequencies(batches):
    import pyarrow as pa

    C.worker_for("language", lambda: None)
    df, n = np.zeros(DIMS, np.int64), 0
    for whole in batches:
        for batch in C.slices(whole):
            for text in batch["text"].to_pylist():
                c = None if text is None else counts(text)
                if c is not None:
                    df += c > 0
                    n += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, DIMS), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["dim", "n"])


def _rows_of_counts(batches):
    import pyarrow as pa

    for whole in batches:
        for batch in C.slices(whole):
            rows = []
            for lang, order, text in zip(batch["lang"].to_pylist(), batch["_order"].to_pylist(), batch["text"].to_pylist(), strict=True):
                c = None if text is None else counts(text)
                if c is not None:
                    at = np.flatnonzero(c)
                    rows.append((lang, order, at.astype("<u4").tobytes(), np.minimum(c[at], 2**31 - 1).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "_order", "at", "n"])


def _trainer(idf: np.ndarray, langs: list[str]):
    """Over the sample (_pass, lang, _order, at, n), once for each pass and in the same order: EPOCHS passes learn from
    four documents of five, the last one takes the logits of the fifth."""
    import pyarrow as pa

    def run(batches):
        model, w, logits, labels = Ftrl(len(langs)), None, [], []
        was, i = -1, -1
        for batch in batches:
            for turn, lang, at, n in zip(*(batch[k].to_pylist() for k in ("_pass", "lang", "at", "n")), strict=True):
                was, i = turn, i + 1 if turn == was else 0
                if (i % 5 == 0) != (turn == EPOCHS):
                    continue
                at = np.frombuffer(at, "<u4").astype(np.int64)
                x = (1 + np.log(np.frombuffer(n, "<u4").astype(np.float64))) * idf[at]
                x = (x / np.sqrt(x @ x)).astype(np.float32)
                if turn < EPOCHS:
                    model.learn(at, x, langs.index(lang))
                else:
                    w = model.weights() if w is None else w
                    logits.append(x @ w[at] + w[DIMS])
                    labels.append(langs.index(lang))
        w = model.weights() if w is None else w
        rows = np.flatnonzero(np.abs(w).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((rows.astype(np.int32), w[rows].astype(np.float32), temperature(logits, labels)))], pa.binary())], names=["model"])

    return run


def train(labelled: DataFrame, scratch: C.Scratch, per_lang: int = SAMPLE_PER_LANG) -> dict:
    """A model from labelled rows (doc_id, text, lang). What comes to the driver: DIMS document frequencies, a row for
    each language, and the weights that aren't 0."""
    labelled = labelled.filter(F.col("lang").isNotNull())
    sums = labelled.select("text").mapInArrow(_frequencies, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS + 1)
    for r in sums:
        df[r.dim] = r.n
    idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1
    sizes = {r.lang: r["count"] for r in labelled.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs or not df[DIMS]:
        return {"langs": [], "idf": idf, "w": np.zeros((DIMS, 0), np.float32), "b": np.zeros(0), "t": 1.0}
    order = F.xxhash64(F.lit(6), "doc_id", "text")  # of the text too: ids may be null
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, per_lang / sizes[k])))])
    chosen = labelled.withColumn("_order", order).filter(F.pmod(F.col("_order"), F.lit(1_000_003)) / 1_000_003.0 < F.element_at(share, F.col("lang")))
    once = chosen.select("lang", "_order", "text").dropDuplicates(["lang", "_order"])
    rows = scratch.keep(once.mapInArrow(_rows_of_counts, "lang string, _order long, at binary, n binary"), "sample", 4 * per_lang * len(langs), 1 << 12)
    passes = rows.select(F.explode(F.array(*map(F.lit, range(EPOCHS + 1)))).alias("_pass"), "lang", "_order", "at", "n")
    got = passes.repartition(1).sortWithinPartitions("_pass", "_order", "lang").mapInArrow(_trainer(idf, langs), "model binary").collect()
    at, w, t = pickle.loads(got[0].model)
    full = np.zeros((DIMS + 1, len(langs)), np.float32)
    full[at] = w
    return {"langs": langs, "idf": idf, "w": full[:DIMS], "b": full[DIMS].astype(float), "t": t}


def predict_one(text: str | None, model: dict) -> tuple[str, float]:
    c = None if text is None else counts(text)
    if c is None or not model["langs"]:
        return "und", 0.0
    at, x = features(c, model["idf"])
    p = softmax((x @ model["w"][at] + model["b"]) / model["t"])
    k = int(p.argmax())
    return model["langs"][k], float(p[k])


def predict(docs: DataFrame, model: dict, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of each row of docs (key, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS rows of one number for each language

    def run(batches):
        import pyarrow as pa

        C.worker_for("language", lambda: None)
        for whole in batches:
            for batch in C.slices(whole):
                got = [predict_one(t, shared.value) for t in batch["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch[key], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[key, "lang_pred", "score"])

    d = docs.select(key, "text")
    return d.mapInArrow(run, d.select(key).schema.add("lang_pred", "string").add("score", "double"))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train(docs.filter(fold(F.col("doc_id")) != 2), C.Scratch(spark, "op6"))
    return predict(docs, model).select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")


def least_score(model: dict) -> float:
    return min(1.0, LEAST_OF_GUESS / max(1, len(model["langs"])))


def stage_language_id(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of no language, or of one with less than least_score, go. Where nothing could be learned
    all stay. A null text has no language; rows that repeat share their fate; columns may have any names. Verdicts come
    back from Python, texts don't."""
    scratch = C.Scratch(spark, "stage-lang", C.STAGE_BYTES)
    rows = C.with_row_id(C.boxed(docs), scratch)
    model = train(docs.select("doc_id", "text", "lang").filter(fold(F.col("doc_id")) != 2), scratch)
    if not model["langs"]:
        return docs
    rejected = predict(rows.select("_row", "text"), model, "_row").filter((F.col("lang_pred") == "und") | (F.col("score") < least_score(model)))
    n = rows.count()
    dropped = scratch.keep(rejected.select("_row"), "dropped", n, C.DOC_ROWS)
    return C.packed(C.split_rows(rows.select("_doc", "_row"), dropped, scratch, rows=n)[1].select("_doc.*"), n)
