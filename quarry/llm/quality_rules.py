"""Quality rules under weak supervision: rules vote or abstain, expectation-maximisation estimates how far each can be trusted, and the posterior decides.

Each rule is a measure of the whole text with two ranges: in one it votes that the document is good, outside the other that it is bad; between them, or where the text gives it too little to measure, it abstains.
The label model (Dawid and Skene's for two classes): a rule that votes is right on good documents with one probability and on bad ones with another, whatever other rules say; that it abstains says nothing. EM over the counts of distinct vote patterns estimates these and the share of good documents. It starts from the all-must-pass verdict (any bad vote: probably bad), so classes can't turn round; a rule never counts as worse than chance (the two probabilities add up to 1 at least, so a bad vote never speaks for a document), and imagined votes keep rules that seldom vote near a prior. Documents that fail the plain limits are decided and left out of it. Most bad documents have one defect: rules for other defects are right on few of them, and their good votes then weigh little. No labels are read.

Two steps: one pass over the texts makes measures and vote patterns (a small stored table), then the patterns are counted. There are at most 3^rules of them at any size of the input; they alone reach the driver. The verdict is an expression over a row's votes.

Measures are over words `[^\\x20\\x09-\\x0D]+`, case kept. Lines and windows of words are compared by 64-bit hashes within their own text.

Defined cases: null and empty texts have no words, all counts 0, base_failed true and kept false; rules that have nothing to measure abstain, and a document without any vote has the prior as posterior; repeated rows are judged alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_batches
from quarry.llm.kernel import Kernel, mix, ngrams, slices
from quarry.session import stored

GOOD, BAD, ABSTAIN = 1, 2, 0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_plain_words", "n_letters", "n_upper", "n_digits", "n_ends")
SYMBOLS = b"#*$%&|<>"
BASE_WORDS, BASE_REPEAT = 50, 50


@dataclass(frozen=True)
class Rule:
    """Votes on numerator / denominator (counts of COUNTS): good within [low, high], bad outside [least, most], abstains between and where fewer than `enough` of the denominator are there."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float
    least: float
    most: float
    enough: int = 1

    def votes(self, m: dict[str, np.ndarray]) -> np.ndarray:
        n = m[self.denominator]
        x = m[self.numerator] / np.maximum(n, 1)
        vote = np.where((x >= self.low) & (x <= self.high), GOOD, np.where((x < self.least) | (x > self.most), BAD, ABSTAIN))
        return np.where(n >= self.enough, vote, ABSTAIN)


INF = float("inf")
RULES = (
    Rule("word_length", "word_chars", "n_words", 3, 9, 2.2, 12, 10),
    Rule("symbols", "n_symbols", "n_words", 0, 0.03, 0, 0.1, 10),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 0, 0.1, 0, 0.3, 3),
    Rule("repeated_windows", "n_repeat_words", "n_words", 0, 0.15, 0, 0.4, 20),
    Rule("words_with_letters", "n_alpha_words", "n_words", 0.85, 1, 0.7, 1, 10),
    Rule("plain_words", "n_plain_words", "n_words", 0.8, 1, 0.6, 1, 10),
    Rule("capitals", "n_upper", "n_letters", 0, 0.2, 0, 0.4, 50),
    Rule("digits", "n_digits", "word_chars", 0, 0.08, 0, 0.25, 50),
    Rule("sentence_ends", "n_ends", "n_words", 1 / 50, 0.4, 1 / 200, 0.8, 50),
    Rule("words_a_line", "n_words", "n_lines", 5, INF, 2, INF, 3),
)


class Measures:
    """COUNTS of every text; one per task."""

    def __init__(self) -> None:
        self.kernel = Kernel(lower=False)
        byte = np.arange(256)
        self.symbol = np.isin(byte, list(SYMBOLS))
        self.letter = ((byte >= 65) & (byte <= 90)) | ((byte >= 97) & (byte <= 122)) | (byte >= 0xC0)  # one for each character beyond ASCII
        self.upper, self.digit = (byte >= 65) & (byte <= 90), (byte >= 48) & (byte <= 57)
        self.end, self.closing = np.isin(byte, list(b".!?")), np.isin(byte, list(b".,;:!?"))
        self.inside = self.letter | (byte >= 0x80) | np.isin(byte, list(b"'-"))
        self.starts_point = (byte & 0xC0) != 0x80

    def of(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        k, rows = self.kernel, len(offsets) - 1
        starts, ends, first = k.words(data, offsets)
        prefix = k.prefix(data)

        def per_row(mask: np.ndarray) -> np.ndarray:
            running = np.append(0, np.cumsum(mask))
            return running[offsets[1:]] - running[offsets[:-1]]

        h = k.spans(prefix, starts, ends)
        owner = np.repeat(np.arange(rows), np.diff(first))
        letters = np.append(0, np.cumsum(self.letter[data]))
        out = {"n_words": np.diff(first), "n_symbols": per_row(self.symbol[data]), "n_letters": per_row(self.letter[data]), "n_upper": per_row(self.upper[data]), "n_digits": per_row(self.digit[data]), "n_ends": per_row(self.end[data]), "word_chars": per_row(self.starts_point[data] & ~k.sep[data])}
        out["n_alpha_words"] = np.bincount(owner[letters[ends] > letters[starts]], minlength=rows)
        strange = np.append(0, np.cumsum(~self.inside[data]))
        strange = strange[ends] - strange[starts]
        plain = (strange == 0) | ((strange == 1) & self.closing[data[ends - 1]])  # letters, and one mark at the end
        out["n_plain_words"] = np.bincount(owner[plain], minlength=rows)
        own = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))  # tells the same word of two rows apart
        row, window, place = ngrams(h, first, 3)
        _, inverse, times = np.unique(window ^ own[row], return_inverse=True, return_counts=True)
        often = place[times[inverse] > 1]
        covered = np.zeros(len(h), bool)
        for j in range(3):
            covered[often + j] = True
        out["n_repeat_words"] = np.bincount(owner[covered], minlength=rows)
        breaks = np.flatnonzero(data == 0x0A)
        line_from = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
        line_from = line_from[line_from < len(data)]
        line_row = np.searchsorted(offsets, line_from, "right") - 1
        line_to = np.append(line_from[1:], len(data))
        line_to = np.where((line_to > line_from) & (data[np.maximum(line_to - 1, 0)] == 0x0A), line_to - 1, line_to) if len(line_from) else line_to[:0]
        before = np.searchsorted(starts, line_from)
        filled = np.searchsorted(starts, line_to) > before  # words never cross a line's end
        line_from, line_to, line_row = line_from[filled], line_to[filled], line_row[filled]
        lines = k.spans(prefix, line_from, line_to) ^ own[line_row]
        out["n_lines"] = np.bincount(line_row, minlength=rows)
        out["n_dup_lines"] = out["n_lines"] - np.bincount(line_row[np.unique(lines, return_index=True)[1]], minlength=rows)
        return out


def measured(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Stored (doc_id, COUNTS, pattern): pattern has the rules' votes as digits to the base 3, the first rule's lowest."""

    def make():
        measures = Measures()

        def step(batch: pa.RecordBatch) -> dict:
            parts = [measures.of(data, offsets) for _, _, data, offsets in slices(batch["text"])]
            m = {c: np.concatenate([p[c] for p in parts]).astype(np.int64) for c in COUNTS}
            pattern = np.zeros(batch.num_rows, np.int64)
            for j, rule in enumerate(rules):
                pattern += rule.votes(m) * 3**j
            return {"doc_id": batch["doc_id"]} | {c: pa.array(m[c]) for c in COUNTS} | {"pattern": pa.array(pattern)}

        return step

    return stored(map_batches(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", pattern long"))


@dataclass(frozen=True)
class LabelModel:
    """share: of good documents; on_good, on_bad: P(a vote is good | good), P(a vote is bad | bad), by rule."""

    share: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def log_odds(self) -> tuple[float, list[tuple[float, float, float]]]:
        """The prior's log-odds of good, and what every rule's (abstention, good vote, bad vote) adds."""
        by_rule = [(0.0, math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(self.on_good, self.on_bad)]
        return math.log(self.share / (1 - self.share)), by_rule


def digits(patterns: np.ndarray, rules: int) -> np.ndarray:
    return np.stack([patterns // 3**j % 3 for j in range(rules)], axis=1) if rules else np.zeros((len(patterns), 0), np.int64)


def fit(patterns: np.ndarray, counts: np.ndarray, rules: int, prior: float = 10.0, prior_good: float = 0.95, prior_bad: float = 0.2, rounds: int = 500, limit: float = 0.9999) -> LabelModel:
    """EM over vote patterns with their numbers of documents. prior: so many imagined votes of each rule on either class, of which prior_good and prior_bad are right, and so many imagined documents, half of them good."""
    order = np.argsort(patterns)
    v, n = digits(patterns[order], rules), counts[order].astype(float)
    good, bad = (v == GOOD).astype(float), (v == BAD).astype(float)
    p = n * np.where(bad.any(axis=1), 0.1, 0.9)
    last = None
    for _ in range(rounds):
        q = n - p
        on_good = np.clip((p @ good + prior * prior_good) / (p @ (good + bad) + prior), 1 - limit, limit)
        on_bad = np.clip(np.maximum((q @ bad + prior * prior_bad) / (q @ (good + bad) + prior), 1 - on_good), 1 - limit, limit)
        s = float((p.sum() + prior / 2) / (n.sum() + prior))
        now = np.concatenate([on_good, on_bad, [s]])
        if last is not None and np.abs(now - last).max() < 1e-9:
            break
        last = now
        z = np.log(s / (1 - s)) + good @ np.log(on_good / (1 - on_bad)) + bad @ np.log((1 - on_good) / on_bad)
        p = n / (1 + np.exp(-np.clip(z, -500, 500)))
    return LabelModel(s, tuple(on_good.tolist()), tuple(on_bad.tolist()))


def base_failed() -> Column:
    """The plain limits: too few words, or too many in repeated windows."""
    return (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT * F.col("n_words"))


def trained(rows: DataFrame, rules: tuple[Rule, ...] = RULES) -> LabelModel:
    """The label model of the patterns of measured(), over the rows that the plain limits leave open."""
    got = rows.where(~base_failed()).groupBy("pattern").count().collect()  # at most 3^rules rows
    return fit(np.array([r[0] for r in got], np.int64), np.array([r[1] for r in got], np.int64), len(rules))


def posterior(model: LabelModel, pattern: Column) -> Column:
    """P(good | votes)."""
    z, by_rule = model.log_odds()
    total = F.lit(z)
    for j, by_vote in enumerate(by_rule):
        digit = F.pmod(F.floor(pattern / 3**j), F.lit(3)).cast("int")
        total = total + F.when(digit == GOOD, by_vote[GOOD]).when(digit == BAD, by_vote[BAD]).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def judged(rows: DataFrame, model: LabelModel, at_least: float = 0.5) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, posterior and n_votes of the rows of measured()."""
    failed = base_failed()
    p = posterior(model, F.col("pattern"))
    votes = sum((F.when(F.pmod(F.floor(F.col("pattern") / 3**j), F.lit(3)) > 0, 1).otherwise(0) for j in range(len(model.on_good))), F.lit(0))
    return rows.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (p >= at_least)).alias("kept"), p.alias("posterior"), votes.cast("int").alias("n_votes"))


def judge(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The verdict on every document."""
    rows = measured(documents, rules)
    return judged(rows, trained(rows, rules))
