"""Token ids of whole texts by a public tokenizer, with a bounded cache of word encodings.

The tokenizer's pre-tokens never reach over white space and each is encoded by
itself, so a word's ids can be kept.  That holds for texts over ASCII and the
Latin letters below; any other text, and any that may hold a special token, goes
to the tokenizer as it is.
"""

from __future__ import annotations

import os
import re

import numpy as np

# The tokenizer's own split rule, for lower-case texts over ASCII and Latin letters.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ſ"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s{_LETTERS}0-9]+", re.ASCII)
_OTHER = re.compile(rf"[^\x00-\x7f{_LETTERS}]|<\|")
_SPACE = re.compile(r"[ \t\n\r\f\v]")
#: Words whose ids are kept, and characters worked on at once.
CACHED, SEGMENT = 200_000, 1 << 18


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class _Numbers(dict):
    """word -> number, in order of first sight; new words wait in `new`."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Numbers()
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1, dtype=np.int64)  # word n has flat[start[n]:start[n + 1]]
        self.seen = np.zeros(0, dtype=np.int64)  # how often each word was looked up

    def _thin(self) -> None:
        """Keep the half of the words that was looked up most."""
        if self.numbers.new:
            self._learn()
        words = list(self.numbers)
        seen = np.concatenate([self.seen, np.zeros(len(words) - len(self.seen), dtype=np.int64)])
        kept = np.sort(np.argsort(-seen, kind="stable")[: CACHED // 2])
        first, count = self.start[kept], np.diff(self.start)[kept]
        end = np.cumsum(count)
        flat = self.flat[np.repeat(first - end + count, count) + np.arange(end[-1] if len(end) else 0)]
        self._reset()
        self.numbers.update(zip([words[i] for i in kept.tolist()], range(len(kept)), strict=True))
        self.flat = np.concatenate([flat, np.zeros(1 << 16, dtype=np.uint32)])
        self.start = np.concatenate([[0], end])
        self.seen = seen[kept] // 2

    def _learn(self) -> None:
        words, self.numbers.new = self.numbers.new, []
        ids, lengths = [], []
        for at in range(0, len(words), 4096):  # a space parts pre-tokens, whose numbers tell the ids of each
            some = words[at : at + 4096]
            got = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ids.append(np.array(got.ids, dtype=np.uint32))
            lengths.append(np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(some)))
        ids, lengths = np.concatenate(ids), np.concatenate(lengths)
        end = self.start[-1] + np.cumsum(lengths)
        if end[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), int(end[-1])), dtype=np.uint32)])
        self.flat[self.start[-1] : end[-1]] = ids
        self.start = np.concatenate([self.start, end])

    def _look(self, text: str) -> np.ndarray:
        words = _SPLIT.findall(text)
        return np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words numbered in `at`, and the words' ends among them."""
        if self.numbers.new:
            self._learn()
        seen = np.bincount(at, minlength=len(self.numbers))
        seen[: len(self.seen)] += self.seen
        self.seen = seen
        first = self.start[at]
        count = self.start[at + 1] - first
        total = np.cumsum(count)
        return self.flat[np.repeat(first - total + count, count) + np.arange(total[-1] if len(total) else 0)], total

    def _long(self, text: str) -> np.ndarray:
        out, at = [], 0
        while at < len(text):
            cut = _SPACE.search(text, at + SEGMENT)
            to = cut.start() if cut else len(text)
            if len(self.numbers) > CACHED:
                self._thin()
            out.append(self._gather(self._look(text[at:to]))[0])
            at = to
        return np.concatenate(out)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text, without special tokens."""
        out: list = [None] * len(texts)
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def flush() -> None:
            if not held:
                return
            ids, ends = self._gather(np.concatenate([at for _, at in held]))
            ends = np.concatenate([[0], ends])[np.cumsum([len(at) for _, at in held])]
            for (i, _), a, b in zip(held, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[i] = ids[a:b]
            held.clear()

        for i, text in enumerate(texts):
            if _OTHER.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
                continue
            if size + len(text) > SEGMENT:
                flush()
                size = 0
                if len(self.numbers) > CACHED:
                    self._thin()
            text = text.lower()
            if len(text) > SEGMENT:
                out[i] = self._long(text)
                continue
            size += len(text)
            held.append((i, self._look(text)))
        flush()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
