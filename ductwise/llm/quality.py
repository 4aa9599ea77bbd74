"""Quality by compression: how much better do good texts' bytes compress with a dictionary of good than of bad text?

Two zstandard dictionaries are built from labelled text.  A text is compressed in blocks with each;
the difference of the compressed sizes over the bytes of the text, and over their square root, is calibrated on
labelled texts that neither dictionary has seen.  Lines that several training texts share tell
nothing about a class and are left out of the dictionaries.

Defined results: null and empty texts have difference 0 and so the score of a text without evidence; equal texts
get equal scores; other columns are ignored; without both labels the score is the share of label 1, 0.5 without any.
A text of any length is compressed whole, block by block; only training leaves texts above ``LONGEST`` characters out.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._runtime import class_shares, fold, tidy, training_rows, tune
from .calibration import Logistic, class_weights

#: Labelled texts of each class that are learnt from at most: half for the dictionaries, half for calibration.
PER_CLASS = 1500
BLOCK = 512
DICTIONARY = 32 * 1024
LEVEL = 3
#: Bytes at which a text's differences count half: a few words may be in either dictionary by chance.
SHORT = 100
SCORED = "doc_id long, held_out boolean, score double, predicted int, difference double"


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(texts: list[str], common: set[str]) -> bytes:
    import zstandard

    samples: list[bytes] = []
    for t in texts:
        samples += _blocks("\n".join(x for x in t.split("\n") if x not in common).encode("utf-8", "replace"))
    samples = [s for s in samples if len(s) >= 16]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little text for the trainer: the text itself serves
        return b"".join(samples)[-DICTIONARY:]


class Model:
    """Two dictionaries and the calibration."""

    def __init__(self, rows: list[tuple[int, str, int]], shares: dict[int, float]):
        self.prior = shares.get(1, 0.0) if shares else 0.5
        self.dictionaries = self.calibrated = None
        fit, rest = rows[::2], rows[1::2]
        if len({y for _, _, y in fit}) < 2 or len({y for _, _, y in rest}) < 2:
            return
        seen = Counter(line for _, t, _ in fit for line in set(t.split("\n")))
        common = {line for line, n in seen.items() if n > 1}
        self.dictionaries = [_dictionary([t for _, t, y in fit if y == c], common) for c in (1, 0)]
        x = np.array([self.features(t.encode("utf-8", "replace")) for _, t, _ in rest])
        y = np.array([y for _, _, y in rest])
        self.calibrated = Logistic(x, y, class_weights(y, shares))

    def _compressors(self):
        import zstandard

        if getattr(self, "_pair", None) is None:
            self._pair = []
            for d in self.dictionaries:
                data = zstandard.ZstdCompressionDict(d)
                data.precompute_compress(level=LEVEL)
                self._pair.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress)
        return self._pair

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def features(self, data: bytes) -> tuple[float, float, float]:
        """(difference by byte, by square root of bytes, largest advantage of the bad dictionary in a block)."""
        if not data:
            return 0.0, 0.0, 0.0
        good, bad = self._compressors()
        total, worst = 0, 0.0
        for block in _blocks(data):
            gap = len(bad(block)) - len(good(block))
            total += gap
            worst = min(worst, gap)
        trust = len(data) / (len(data) + SHORT)
        return trust * total / len(data), trust * total / len(data) ** 0.5, trust * worst / BLOCK

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(score, normalised difference) of each text."""
        if self.calibrated is None:
            return np.full(len(texts), self.prior), np.zeros(len(texts))
        x = np.array([self.features((t or "").encode("utf-8", "replace")) for t in texts], float).reshape(-1, 3)
        return self.calibrated(x), x[:, 0]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    return Model(training_rows(docs, labels, "quality", per_class), class_shares(labels, "quality"))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """A row for each document. Columns: ``SCORED``."""
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            score, difference = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(difference)],
                ["doc_id", "held_out", "score", "predicted", "difference"],
            )

    held_out = F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out")
    return docs.select("doc_id", "text", held_out).mapInArrow(tidy(run), SCORED)


def keep(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text isn't rejected: score below ``threshold`` times (n / (n + ``SHORT``))^2 for n bytes.

    The factor falls with the trust that the features have too: the fewer bytes, the surer the classifier must be of label 0.
    """
    tune(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            score, _ = model.scores(texts)
            n = np.fromiter((len((t or "").encode("utf-8", "replace")) for t in texts), float, len(texts))
            yield batch.filter(pa.array(score >= threshold * (n / (n + SHORT)) ** 2, pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
