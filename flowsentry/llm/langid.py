"""Language identification by error-correcting output codes (operator 3).

Every language has a codeword of +1/-1 bits; one binary classifier per bit reads hashed byte
n-grams of the whole text.  A text gets the language whose codeword has the smallest
loss-weighted distance to the predicted bits; a small margin to the runner-up is flagged.

The classifiers are fitted on a bounded sample of labelled rows (about ``sample`` rows, shared
out evenly over the languages); only their weights (``bins`` x bits numbers) reach the tasks.

Edge cases: a NULL text or one without a letter is ``und`` with score 0; rows with a NULL
``lang`` or ``doc_id`` are predicted but never learned from; with no labelled row at all every
text is ``und``; repeated rows are predicted each; extra columns are ignored.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, held_out, learnable, text_chunks

UNDETERMINED = "und"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))
_K = np.uint32(2654435761)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """``n`` codewords: all dichotomies up to 5 languages, else the random code of largest distance."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 5:
        cols = [(1,) + c for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(cols, float).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng = np.random.default_rng(seed)
    best, most = None, -1
    for _ in range(50):
        m = np.where(rng.random((n, bits)) < 0.5, 1.0, -1.0)
        m = m[:, np.abs(m.sum(axis=0)) < n]
        apart = m @ m.T
        np.fill_diagonal(apart, -bits)
        nearest = (m.shape[1] - apart.max()) / 2
        if nearest > most:
            best, most = m, nearest
    return best


def grams(raw: bytes, off: np.ndarray, bits: int):
    """Hashed byte 2- and 4-grams of a run of rows: ``(row, bin)`` positions in row order.

    Anything but letters and non-ASCII bytes counts as a blank; a run starts and ends with blanks,
    so no gram spans two rows unseen by the row bounds.
    """
    folded = raw.translate(_FOLD)
    buf = np.frombuffer(folded + b"    ", np.uint8)
    quad = np.ndarray((len(raw) + 1,), "<u4", buffer=buf, strides=(1,))[:len(raw)]
    shift = np.uint32(32 - bits)
    four = (quad * _K) >> shift
    two = ((quad & np.uint32(0xFFFF)) * _K + np.uint32(0x9E3779B9)) * _K >> shift
    return two, four


def row_sums(values: np.ndarray, off: np.ndarray, skip: int) -> np.ndarray:
    """Sum of position values per row, leaving out the last ``skip`` positions of a row (they look into the next)."""
    total = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[np.maximum(off[1:] - skip, off[:-1])] - total[off[:-1]]


@dataclass
class Model:
    langs: list
    code: np.ndarray        # language x bit
    weight: np.ndarray      # bin x bit
    bias: np.ndarray
    trust: np.ndarray       # weight of each bit in the decoding
    bits: int

    def margins(self, raw: bytes, off: np.ndarray) -> np.ndarray:
        """Raw bit predictions per row."""
        n = np.maximum(np.diff(off), 1)[:, None]
        two, four = grams(raw, off, self.bits)
        return (row_sums(self.weight[two], off, 1) + row_sums(self.weight[four], off, 3)) / n + self.bias

    def decode(self, f: np.ndarray):
        """Best language, its share of the decoding weight, and the ambiguity flag per row."""
        loss = np.logaddexp(0.0, -f[:, None, :] * self.code[None]) @ self.trust
        order = np.argsort(loss, axis=1, kind="stable")
        e = np.exp(loss.min(axis=1, keepdims=True) - loss)
        score = 1.0 / e.sum(axis=1)
        if len(self.langs) > 1:
            rows = np.arange(len(f))
            gap = loss[rows, order[:, 1]] - loss[rows, order[:, 0]]
        else:
            gap = np.full(len(f), np.inf)
        return order[:, 0], score, gap < 0.5


def sample_rows(docs: DataFrame, sample: int) -> DataFrame:
    """About ``sample`` labelled training rows, evenly over the languages, chosen by hash."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id"), 4))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return labelled.where(F.lit(False))
    quota = max(1, sample // len(sizes))
    share = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, quota / v)))])
    take = F.pmod(F.xxhash64("doc_id", F.lit("lang-sample")), F.lit(1 << 40)) < share[F.col("lang")] * F.lit(1 << 40)
    return labelled.where(take)


def dense(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of half-precision bytes as one single-precision matrix, filled row by row."""
    x = np.empty((len(column), width), np.float32)
    for i, row in enumerate(column):
        x[i] = np.frombuffer(row.as_buffer(), np.float16)
    return x


def mean_squares(x: np.ndarray, width: int = 256) -> np.ndarray:
    """Mean square of each column; only ``width`` columns of squares exist at a time."""
    return np.concatenate([(x[:, k:k + width] ** 2).mean(axis=0) for k in range(0, x.shape[1], width)])


def fit(docs: DataFrame, sample: int = 3000, bits: int = 12, steps: int = 150) -> Model | None:
    """Logistic bit classifiers on gram frequencies of the sample."""
    def histograms(batches):
        for batch in batches:
            for i, raw, off in text_chunks(batch.column(0)):
                two, four = grams(raw, off, bits)
                rows, size = [], len(raw)
                for a, b in zip(off[:-1], off[1:]):
                    x = np.bincount(two[a:max(a, b - 1)], minlength=1 << bits) + np.bincount(
                        four[a:max(a, b - 3)], minlength=1 << bits)
                    rows.append((x / max(b - a, 1)).astype(np.float16).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1).slice(i, len(rows))],
                                                 ["x", "lang"])

    got = sample_rows(docs, sample).select("text", "lang").mapInArrow(histograms, "x binary, lang string").toArrow()
    if not got.num_rows:
        return None
    said = got.column("lang").to_pylist()
    langs = sorted(set(said))
    y = np.array([langs.index(lang) for lang in said])
    x = dense(got.column("x"), 1 << bits)
    del got
    pa.default_memory_pool().release_unused()
    code = codewords(len(langs))
    target = code[y].astype(np.float32)
    weigh = (1.0 / np.bincount(y, minlength=len(langs)))[y].astype(np.float32)
    weigh /= weigh.sum()
    spread = np.sqrt(mean_squares(x)) + 1e-3
    x /= spread
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, vw = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        f = x @ w + b
        g = -target / (1 + np.exp(np.clip(target * f, -30, 30))) * weigh[:, None]
        gw = x.T @ g + 1e-5 * w
        mw += 0.1 * (gw - mw)
        vw += 0.01 * (gw * gw - vw)
        w -= 0.02 * (mw / (1 - 0.9 ** k)) / (np.sqrt(vw / (1 - 0.99 ** k)) + 1e-8)
        b -= 0.5 * g.sum(axis=0)
    f = x @ w + b
    right = ((f * target > 0) * weigh[:, None]).sum(axis=0)
    trust = np.clip(np.log((right + 1e-3) / (1 - right + 1e-3)), 0.1, None)     # better bits count more
    trust *= 4.0 / trust.sum()
    return Model(langs, code, (w / spread[:, None]).astype(np.float32), b.astype(float), trust, bits)


def has_letter(text: str | None) -> bool:
    return text is not None and (any(c.isalpha() for c in text[:200]) or any(c.isalpha() for c in text))


def predictor(model: Model | None):
    """Function of a text column: languages, scores, ambiguity flags."""
    def run(texts):
        lang, score, vague = [], [], []
        for i, raw, off in text_chunks(texts, 1 << 18):
            n = len(off) - 1
            if model is None:
                lang += [UNDETERMINED] * n
                score += [0.0] * n
                vague += [True] * n
                continue
            best, s, flag = model.decode(model.margins(raw, off))
            for k in range(n):
                if not has_letter(texts[i + k].as_py()):
                    lang.append(UNDETERMINED)
                    score.append(0.0)
                    vague.append(True)
                else:
                    lang.append(model.langs[best[k]])
                    score.append(float(s[k]))
                    vague.append(bool(flag[k]))
        return lang, score, vague

    return run


def identify(docs: DataFrame, sample: int = 3000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, ambiguous`` per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def run(batches):
        predict = predictor(shared.value)
        for batch in batches:
            lang, score, vague = predict(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(lang, pa.string()),
                 pa.array(score, pa.float64()), pa.array(vague, pa.bool_())],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text", held_out(F.col("doc_id"), 4).alias("held_out")).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, sample: int = 3000, sure: float = 0.95) -> DataFrame:
    """Rows with a recognised language, all columns: those without any letter go, and those whose
    declared ``lang`` a clear prediction (not ambiguous, score at least ``sure``) contradicts.

    A language that no training row carries cannot be contradicted, and without any labelled row
    nothing but a missing letter speaks against a text: such rows stay.
    """
    from .common import keep_rows

    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))

    def test(batch):
        model = shared.value
        texts = batch.column(batch.schema.get_field_index("text"))
        if model is None:
            return [has_letter(t.as_py()) for t in texts]
        lang, score, vague = predictor(model)(texts)
        said = batch.column(batch.schema.get_field_index("lang")).to_pylist()
        return [p != UNDETERMINED and (v or x < sure or s not in model.langs or s == p)
                for p, x, v, s in zip(lang, score, vague, said)]

    return keep_rows(docs, test)
