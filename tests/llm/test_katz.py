"""Katz backoff against a plain model of counted pairs."""

import math
import zlib
from collections import Counter

import pytest

from salesmart.llm import katz

START, END = "<s>", "</s>"


def words(text):
    return [word.decode() for word in (text or "").encode().lower().split()] + [END]


def held_out(key):
    return zlib.crc32(b"" if key is None else str(key).encode()) % 5 == 1


class Plain:
    def __init__(self, texts):
        self.words, self.pairs, self.contexts = Counter(), Counter(), Counter()
        for text in texts:
            line = words(text)
            self.words.update(line)
            self.pairs.update(zip([START, *line], line, strict=False))
            self.contexts.update([START, *line[:-1]])
        self.total = sum(self.words.values())
        self.word_kept, self.pair_kept = self.kept(self.words), self.kept(self.pairs)
        self.left = sum(c * (1 - self.word_kept.get(c, 1)) for c in self.words.values()) / max(1, self.total)
        self.over, self.taken = Counter(), Counter()
        for (context, word), count in self.pairs.items():
            self.over[context] += count * (1 - self.pair_kept.get(count, 1))
            self.taken[context] += self.word(word)

    @staticmethod
    def kept(counts):
        number = Counter(counts.values())
        common = 6 * number[6] / number[1] if number[1] else 1
        kept = {}
        for r in range(1, 6):
            value = 0
            if number[r] and common < 1:
                value = ((r + 1) * number[r + 1] / (r * number[r]) - common) / (1 - common)
            kept[r] = value if 0 < value < 1 else (r - 0.5) / r
        return kept

    def word(self, word):
        count = self.words[word]
        if self.left > 0:
            return count * self.word_kept.get(count, 1) / self.total if count else self.left
        return max(count, 1) / (self.total + 1)

    def after(self, context, word):
        held = self.contexts[context]
        if not held:
            return self.word(word)
        extra = self.over[context] <= 0
        count = self.pairs[context, word]
        if count:
            return count * self.pair_kept.get(count, 1) / (held + extra)
        rest = 1 / (held + 1) if extra else self.over[context] / held
        return rest / (1 - self.taken[context]) * self.word(word)

    def base(self, line):
        scale = self.total + 0.5 * (len(self.words) + 1)
        return sum(math.log10((self.words[word] + 0.5) / scale) for word in line)

    def score(self, line):
        return sum(math.log10(self.after(c, w)) for c, w in zip([START, *line], line, strict=False))


def check(docs):
    rows = katz.score_documents(docs).collect()
    texts = [(row["doc_id"], row["text"]) for row in docs.select("doc_id", "text").collect()]
    plain = Plain(text for key, text in texts if not held_out(key))
    want = sorted(((key, held_out(key), words(text)) for key, text in texts), key=lambda x: (str(x[0]), len(x[2])))
    rows.sort(key=lambda row: (str(row["doc_id"]), row["n_tokens"]))
    assert len(rows) == len(want)
    for row, (key, held, line) in zip(rows, want, strict=True):
        assert (row["doc_id"], row["held_out"], row["n_tokens"]) == (key, held, len(line))
        assert row["n_known"] == sum(plain.words[word] > 0 for word in line)
        assert row["train_tokens"] == plain.total
        assert row["base_score"] == pytest.approx(plain.base(line), rel=1e-9)
        assert row["score"] == pytest.approx(plain.score(line), rel=1e-9)
    return plain


def test_scores_equal_a_plain_model(sf_docs, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 20_000)
    plain = check(sf_docs)
    for context in (START, "the", max(plain.contexts), "never seen"):
        every = sum(plain.after(context, word) for word in plain.words)
        assert every + plain.after(context, "\0unknown") == pytest.approx(1)


def test_held_out_texts_are_not_learned(spark):
    held = [key for key in range(40) if held_out(key)][:2]
    rows = [(key, "the river changed its bed") for key in range(12) if not held_out(key)]
    check(spark.createDataFrame([*rows, (held[0], "unseen words"), (held[1], None)], "doc_id long, text string"))


def test_little_text_and_no_discounts(spark):
    rows = [(key, "same") for key in range(60) if not held_out(key)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_odd_rows(odd_docs, no_docs):
    check(odd_docs)
    assert katz.score_documents(no_docs).collect() == []
    only_held = odd_docs.where("doc_id IS NULL").limit(0)
    assert katz.score_documents(only_held).count() == 0
