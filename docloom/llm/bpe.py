"""Byte-pair merging of many words at once, for word-end vocabularies of the kind of word_bpe_49k.json.

The library's tokenizer is the definition; this applies the same merges, read from the same file, to
whole arrays of words. It takes words of ASCII and Latin-1 letters and ASCII signs only, where the
vocabulary's rules (composition, lower case, runs of letters, single digits, runs of other signs) are a
matter of byte classes, and leaves every other word, and words with an apostrophe or the beginning of an
added name (such as <|endoftext|>), to the library.
"""

from __future__ import annotations

import json

import numpy as np

from docloom.llm import shared as S

_NONE = np.uint32(2**32 - 1)
#: Pieces longer than this many bytes are left to the library.
LONGEST = 32


def _byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + rest.index(b)) for b in range(256)]


class Merges:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        #: The first two bytes (one, of a single byte) of the names that the file adds to the vocabulary.
        self.added = sorted({t["content"].lower().encode()[:2] for t in file.get("added_tokens") or []})
        vocab, chars = model["vocab"], _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int32)
        self.final = np.array([vocab[c + model["end_of_word_suffix"]] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.table = S.HashTable(18)
        self.table.add(left << np.uint64(32) | right)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NONE (as the unsigned -1) for those that do not merge."""
        return self.table.find(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)).view(np.uint32)

    def _merged(self, tokens: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges rows of one matrix (padding after each row's length) until none applies."""
        n, width = tokens.shape
        ranks = np.full((n, width), _NONE, np.uint32)
        for j in range(width - 1):
            some = length > j + 1
            ranks[some, j] = self.rank(tokens[some, j], tokens[some, j + 1])
        out, left = tokens.copy(), length.copy()
        rows = np.arange(n)
        columns = np.arange(width)
        while len(rows):
            j = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), j]
            go = best < _NONE
            if not go.all():
                out[rows[~go]], left[rows[~go]] = tokens[~go], length[~go]
                rows, tokens, ranks, length, j, best = rows[go], tokens[go], ranks[go], length[go], j[go], best[go]
                if not len(rows):
                    break
            shift = np.minimum(columns + (columns > j[:, None]), width - 1)
            tokens, ranks = np.take_along_axis(tokens, shift, 1), np.take_along_axis(ranks, shift, 1)
            each = np.arange(len(rows))
            tokens[each, j] = self.made[best]
            length = length - 1
            ranks[:, -1] = _NONE
            ranks[each, j] = _NONE
            some = j + 1 < length
            ranks[each[some], j[some]] = self.rank(tokens[each[some], j[some]], tokens[each[some], j[some] + 1])
            some = j > 0
            ranks[each[some], j[some] - 1] = self.rank(tokens[each[some], j[some] - 1], tokens[each[some], j[some]])
        return out, left

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(taken, ids, counts): which words these rules cover, and the ids of those, in order."""
        size = end - start
        flat = data[S.ragged(start, size)]
        word_end = np.cumsum(size)
        n = len(flat)
        before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        before[1:], after[:-1] = flat[:-1], flat[1:]
        begins = word_end - size
        before[begins], after[word_end - 1] = 0, 0
        lead = flat == 0xC3
        tail = (flat >= 0x80) & (flat <= 0xBF) & (before == 0xC3)
        accented = tail & (flat != 0x97) & (flat != 0xB7)
        ascii_letter = ((flat | 0x20) >= 97) & ((flat | 0x20) <= 122)
        bad = ((flat >= 0x80) & ~(lead & (after != 0x97) & (after != 0xB7)) & ~accented) | (flat == 0x27) | (flat < 0x21) | (flat == 0x7F)
        low = flat.copy()
        low[(flat >= 65) & (flat <= 90)] += 32
        low[accented & (flat <= 0x9E)] += 32
        kind = np.where(ascii_letter | lead | accented, 1, np.where((flat >= 48) & (flat <= 57), 2, 3)).astype(np.int8)
        new = np.ones(n, bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        new[begins] = True
        at = np.flatnonzero(new)
        length = np.diff(np.append(at, n))
        owner = np.searchsorted(word_end, at, "right")
        taken = np.add.reduceat(bad, begins) == 0 if n else np.zeros(0, bool)
        taken[owner[length > LONGEST]] = False
        # a word that may hold an added name such as <|endoftext|>, anywhere in it, is the library's
        for head in self.added:
            here = low == head[0]
            if len(head) > 1:
                here[:-1] &= low[1:] == head[1]
                here[word_end - 1] = False
            taken[np.searchsorted(word_end, np.flatnonzero(here), "right")] = False
        use = taken[owner]
        at, length, owner = at[use], length[use], owner[use]
        rows, lengths = np.zeros((len(at), 1), np.int32), np.zeros(len(at), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for shortest, longest in ((1, 4), (5, 7), (8, 10), (11, 16), (17, LONGEST)):
            mine = np.flatnonzero((length >= shortest) & (length <= longest))
            if len(mine):
                index = np.minimum(at[mine, None] + np.arange(longest), n - 1)
                tokens = self.inner[low[index]]
                tokens[np.arange(len(mine)), length[mine] - 1] = self.final[low[at[mine] + length[mine] - 1]]
                rows, lengths[mine] = self._merged(tokens, length[mine])
                parts.append((mine, rows[np.arange(longest) < lengths[mine, None]]))
        first = np.cumsum(lengths) - lengths
        ids = np.zeros(int(lengths.sum()), np.uint32)
        for mine, values in parts:
            ids[S.ragged(first[mine], lengths[mine])] = values
        counts = np.bincount(owner, lengths, len(size)).astype(np.int64)
        return taken, ids, counts[taken]
