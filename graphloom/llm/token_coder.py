"""Token ids of many texts, with the words seen before remembered.

A byte-level tokenizer never merges across a space that follows or precedes a visible
character, so a text is cut at such spaces and every piece is encoded once per worker; the
pieces' ids are then put together by array look-ups. Pieces are encoded by the library, many
new ones as one text. A text with a longer run of white space, or with a very
long piece, goes to the library whole. The ids are those of the whole text in each case.
"""

from __future__ import annotations

import itertools
import os
from collections import defaultdict
from functools import cached_property

import numpy as np
import tokenizers

#: Pieces longer than this are not worth remembering.
LONGEST = 100
#: Pieces remembered by a worker before it forgets the rare ones; bounds memory, not results.
MOST_PIECES = 1_000_000

#: A piece of a word and one of these is put together from the word's ids and the mark's, where
#: the tokenizer parts the two. Letters up to this one are letters in all versions of Unicode.
MARKS = ",.;:!?"
LAST_LETTER = "\u024f"


class Coder:
    """Encodes lists of texts with one tokenizer file."""

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core
        self.file = file
        self.uncached = self.open()  # a cache would only fill up with new pieces
        if hasattr(self.uncached.model, "_resize_cache"):
            self.uncached.model._resize_cache(0)
        vocabulary = self.uncached.get_vocab()
        self.marks = {c: vocabulary[c] for c in MARKS if c in vocabulary} if self.parts_marks() else {}
        self.after_space = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.after_space[i] = token.startswith("Ġ")  # how such files spell a space
        self.forget()

    def open(self) -> tokenizers.Tokenizer:
        tokenizer = tokenizers.Tokenizer.from_file(self.file)
        tokenizer.encode_special_tokens = True  # their strings in a text are plain text
        return tokenizer

    @cached_property
    def tokenizer(self) -> tokenizers.Tokenizer:
        return self.open()

    def parts_marks(self) -> bool:
        """Whether the ids of a word and of the one mark behind it never depend on each other."""
        t = self.uncached
        cuts = isinstance(t.pre_tokenizer, tokenizers.pre_tokenizers.ByteLevel) and t.pre_tokenizer.use_regex
        plain = t.normalizer is None and all(a.special for a in t.get_added_tokens_decoder().values())
        return cuts and plain and isinstance(t.model, tokenizers.models.BPE) and not t.model.dropout

    def forget(self) -> None:
        self.number: dict[str, int] = defaultdict(itertools.count().__next__)
        self.ids = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.opens = np.zeros(0, bool)  # the piece is empty or begins with white space
        self.closes = np.zeros(0, bool)  # the piece is empty or ends with white space
        self.uses = np.zeros(0, np.int32)  # batches with the piece

    def forget_rare(self) -> None:
        """Keep pieces that several batches had, half of ``MOST_PIECES`` at most."""
        kept = self.uses > 1
        if kept.sum() > MOST_PIECES // 2:
            kept[:] = False
            kept[np.argpartition(-self.uses, MOST_PIECES // 2)[:MOST_PIECES // 2]] = True
        pieces = list(itertools.compress(self.number, kept.tolist()))
        start, size, ids = self.start[kept], self.size[kept], self.ids
        opens, closes = self.opens[kept], self.closes[kept]
        self.forget()
        for piece in pieces:
            self.number[piece]
        self.start = np.cumsum(size) - size
        self.ids = ids[np.arange(int(size.sum())) + np.repeat(start - self.start, size)]
        self.size, self.opens, self.closes = size, opens, closes
        self.uses = np.zeros(len(pieces), np.int32)

    def library(self, texts: list[str], new: bool = False) -> list[np.ndarray]:
        """The library's ids of each text; ``new`` ones hold no piece twice."""
        tokenizer = self.uncached if new else self.tokenizer
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype=np.uint32) for e in found]

    def learn(self, new: list[str]) -> None:
        """Encode new pieces, in the order of their numbers. A text's first piece has no space
        before it; it comes with a space in its string, which no other piece contains."""
        known = len(self.size)
        marked = np.array([p[-1:] in self.marks and "A" <= p[-2:-1] <= LAST_LETTER and p[-2].isalpha()
                           for p in new])
        some = list(itertools.compress(new, marked))
        # Words that were seen with a mark only are new pieces as well.
        words = np.fromiter(map(self.number.__getitem__, (p[:-1] for p in some)), np.int64, len(some))
        new = new + self.newest(known + len(new))
        marked = np.append(marked, np.zeros(len(new) - len(marked), bool))
        odd = np.array([not p or p.strip() != p for p in new]) & ~marked
        plain = ~(odd | marked)
        opens, closes = np.zeros(len(new), bool), np.zeros(len(new), bool)
        start, size = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        ids = [self.ids]
        if plain.any():
            every = list(itertools.compress(new, plain))
            joined = [" " + " ".join(every[i:i + 100]) for i in range(0, len(every), 100)]
            for i in range(0, len(joined), 4):
                ids += self.library(joined[i:i + 4], new=True)
            found = np.concatenate(ids[1:])
            begins = np.flatnonzero(self.after_space[found])
            if len(begins) != len(every):
                raise ValueError("the tokenizer joins words across spaces")
            size[plain] = np.diff(begins, append=len(found))
        if odd.any():
            every = list(itertools.compress(new, odd))
            bare = [p[1:] if p.startswith(" ") else p for p in every]
            found = self.library([b if p.startswith(" ") else " " + p for p, b in zip(every, bare)])
            size[odd] = [len(x) for x in found]
            opens[odd] = [not b or b[0].isspace() for b in bare]
            closes[odd] = [not b or b[-1].isspace() for b in bare]
            ids += found
        at = len(self.ids)
        for kind in (plain, odd):
            start[kind] = at + np.cumsum(size[kind]) - size[kind]
            at += int(size[kind].sum())
        self.ids = np.concatenate(ids)
        self.start, self.size = np.append(self.start, start), np.append(self.size, size)
        self.opens, self.closes = np.append(self.opens, opens), np.append(self.closes, closes)
        self.uses = np.append(self.uses, np.zeros(len(new), np.int32))
        if some:
            length = self.size[words] + 1
            ends = np.cumsum(length)
            place = np.arange(int(ends[-1])) + np.repeat(self.start[words] - ends + length, length)
            place[ends - 1] = 0
            found = self.ids[place]
            found[ends - 1] = [self.marks[p[-1]] for p in some]
            number = known + np.flatnonzero(marked)
            self.start[number], self.size[number] = at + ends - length, length
            self.opens[number] = self.opens[words]
            self.ids = np.append(self.ids, found)

    def newest(self, known: int) -> list[str]:
        """The pieces with numbers from ``known`` on."""
        return list(itertools.islice(reversed(self.number), len(self.number) - known))[::-1]

    def numbers(self, pieces: list[str]) -> np.ndarray:
        """The pieces' numbers; those not seen before get the next ones and are learned."""
        known = len(self.number)
        number = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        if known < len(self.number):
            try:
                self.learn(self.newest(known))
            except BaseException:
                self.forget()  # numbers without ids
                raise
        self.uses[number] += 1
        return number

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.number) > MOST_PIECES:
            self.forget_rare()
        out: list = [None] * len(texts)
        pieces: list[str] = []
        at, bounds, whole = [], [0], []
        for k, text in enumerate(texts):
            own = text.split(" ")
            if max(map(len, own)) > LONGEST:
                whole.append(k)
            else:
                own[0] = " " + own[0]
                pieces += own
                at.append(k)
                bounds.append(len(pieces))
        number = self.numbers(pieces)
        if at:
            size = self.size[number]
            ends = np.cumsum(size)
            ids = self.ids[np.arange(int(ends[-1])) + np.repeat(self.start[number] - ends + size, size)]
            clash = self.closes[number]
            clash[:-1] &= self.opens[number[1:]]
            clash[np.array(bounds[1:]) - 1] = False  # the next piece is another text's
            clashes = np.add.reduceat(clash, bounds[:-1], dtype=np.int64)
            for k, own, odd in zip(at, np.split(ids, ends[np.array(bounds[1:-1], np.int64) - 1]), clashes):
                out[k] = own
                if odd:
                    whole.append(k)
        for k, ids in zip(whole, self.library([texts[k] for k in whole])):
            out[k] = ids
        return out


def coder(file: str) -> Coder:
    """The worker's coder of a file; kept with the library, which outlives a task."""
    known = vars(tokenizers).setdefault("_coders", {})
    if file not in known:
        known[file] = Coder(file)
    return known[file]
