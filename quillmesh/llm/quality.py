"""Quality filtering by weak supervision.

Rules look at a text and vote good (1) or bad (-1) or abstain (0). Votes are counted for each combination of
votes over the whole corpus (3 ** rules combinations at most), and expectation-maximisation on these counts
estimates how each rule votes on good and on bad texts. The posterior probability of *good* decides, in place
of a filter that wants every rule to pass.

Null texts have no words. Texts without words fail the base rule; an empty table gives no rows; repeated rows get
equal results each; more columns of the input are left alone.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpoint, per_batch

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: Each rule: name, then whether its measure is (surely good, surely bad); neither: it abstains.
RULES = ("length", "word_length", "symbols", "symbol_chars", "dup_lines", "repeats", "capitals", "top_word", "exclaims")


@dataclass(frozen=True)
class Measures:
    n_words: int
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int
    capitals: float
    top_word: float
    exclaims: int


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three that is found twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, last = 0, -1
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + 3 - max(i, last)
            last = i + 3
    return covered


def measure(text: str | None) -> Measures:
    text = text or ""
    data = text.encode()
    words = data.split()
    seen: set[str] = set()
    lines = dups = 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(SPACES):
                lines += 1
                if line in seen:
                    dups += 1
                seen.add(line)
    else:
        lines = bool(words)
    letters = len(data) - len(data.translate(None, b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    capitals = len(data) - len(data.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    top = max(Counter(words).values(), default=0)
    return Measures(
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), int(lines), dups, repeated_words(words),
        capitals / letters if letters else 0.0, top / len(words) if words else 0.0, text.count("!") + text.count("?"),
    )


def votes(m: Measures) -> list[int]:
    """-1, 0 or 1 of each rule."""
    n = max(m.n_words, 1)

    def ask(value: float, good: float, bad: float) -> int:
        """Small is good."""
        return 1 if value <= good else -1 if value > bad else 0

    mean = m.word_chars / n
    return [
        1 if m.n_words >= 80 else -1 if m.n_words < 50 else 0,
        1 if 2.5 <= mean <= 10 else -1 if mean < 2 or mean > 14 else 0,
        ask(m.n_symbols / n, 0.03, 0.1),
        ask(m.n_symbols / max(m.word_chars, 1), 0.01, 0.04),
        ask(m.n_dup_lines / m.n_lines, 0.2, 0.6) if m.n_lines >= 3 else 0,
        ask(m.n_repeat_words / n, 0.15, 0.4),
        ask(m.capitals, 0.15, 0.4),
        ask(m.top_word, 0.15, 0.25) if m.n_words >= 20 else 0,
        ask(m.exclaims / n, 0.08, 0.3),
    ]


def code_of(cast: list[int]) -> int:
    code = 0
    for v in reversed(cast):
        code = code * 3 + v + 1
    return code


def cast_of(codes: np.ndarray) -> np.ndarray:
    """Votes (0 bad, 1 abstain, 2 good) of each code: a row for each code."""
    return (codes[:, None] // 3 ** np.arange(len(RULES))) % 3


FEATURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, vote_code int"


def _features(batch: pa.RecordBatch) -> pa.RecordBatch:
    found = [measure(t) for t in batch.column("text").to_pylist()]
    put = lambda name: pa.array([getattr(m, name) for m in found], pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), *map(put, ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), pa.array([code_of(votes(m)) for m in found], pa.int32())],
        names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "vote_code"],
    )


def estimate(codes: np.ndarray, counts: np.ndarray, rounds: int = 200, most_wrong: float = 0.004) -> np.ndarray:
    """Posterior probability of good for each code, by expectation-maximisation.

    It starts from votes weighed by how rules are written: they speak against a text far more rarely than for it.
    """
    cast = cast_of(codes)
    chosen = np.eye(3)[cast]
    posterior = 1 / (1 + np.exp(-(0.5 * (cast == 2) - 4.0 * (cast == 0)).sum(axis=1)))
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        # Good texts rarely get bad votes, and the other way round: a weak prior that also names the classes.
        prior = np.array([[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]])
        table = np.einsum("yc,crv->yrv", weight, chosen) + prior[:, None, :]
        table /= table.sum(axis=2, keepdims=True)
        # Each rule is written to be right: on good texts its bad votes are rare.
        table[1, :, 0] = np.minimum(table[1, :, 0], most_wrong)
        table /= table.sum(axis=2, keepdims=True)
        share = (weight.sum(axis=1) + 1) / (weight.sum() + 2)
        logs = np.log(share)[:, None] + np.einsum("yrv,crv->yc", np.log(table), chosen)
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))
        done = np.abs(new - posterior).max(initial=0) < 1e-9
        posterior = new
        if done:
            break
    return posterior


def judge(docs: DataFrame, threshold: float = 0.5, min_words: int = 50) -> DataFrame:
    """Measures, votes, posterior and verdict of each document."""
    spark = docs.sparkSession
    found = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(per_batch(_features), FEATURES))
    seen = found.groupBy("vote_code").count().toPandas()
    codes = seen["vote_code"].to_numpy(np.int64)
    posterior = estimate(codes, seen["count"].to_numpy(np.float64))
    known = spark.createDataFrame([(int(c), float(p)) for c, p in zip(codes, posterior, strict=True)], "vote_code int, posterior double")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return (
        found.join(F.broadcast(known), "vote_code")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )
