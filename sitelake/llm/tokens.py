"""Token ids of whole texts with a public byte-level BPE, a batch at a time.

Such a tokenizer splits a text into words before it looks anything up, and a word always gives the same ids. So the words of a
batch are cut and numbered with array operations, each different word is encoded once per worker, and the ids are put together.
Ids equal those of ``tokenizers`` on the same file; texts with characters on which the libraries' Unicode tables may
differ, or with a special token's string, go to ``tokenizers`` whole.
"""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np
import pandas as pd

from sitelake.llm import text as tx

# Words kept per worker; beyond it the memory is begun anew (ids stay the same).
KEPT_WORDS = 250_000
SPECIAL = "<|endoftext|>"
APOSTROPHE = 0x27
# Ranges in which letters, numbers and blanks are the same in all Unicode tables of the last twenty years.
PLAIN = ((0x09, 0x0D), (0x20, 0x7E), (0xA1, 0x17F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _plain() -> np.ndarray:
    ok = np.zeros(tx.END + 1, dtype=bool)
    for a, b in PLAIN:
        ok[a : b + 1] = True
    ok[tx.END] = True
    return ok


def word_starts(codes: np.ndarray) -> np.ndarray:
    """Where the words of byte-level BPE begin: runs of letters, numbers or others with one space before; blanks but
    for the last one before a word; the contractions 's 't 're 've 'm 'll 'd. END is a word of its own."""
    kind = tx.classes()[codes]
    n = len(codes)
    first = np.ones(n, dtype=bool)
    first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == tx.LAST)
    runs = np.flatnonzero(first)
    # A run of blanks before a word: its last blank is split off, and joins the word if it is a space.
    begin = runs[(kind[runs] != tx.SPACE) & (kind[runs] != tx.LAST) & (runs > 0)]
    begin = begin[kind[begin - 1] == tx.SPACE]
    first[begin - 1] = True
    joined = begin[codes[begin - 1] == 0x20]
    first[joined] = False
    # Contractions: an apostrophe alone, at the start of a word.
    quote = runs[(codes[runs] == APOSTROPHE) & (runs + 2 < n)]
    quote = quote[first[quote] & (kind[quote + 1] == tx.LETTER)]
    one, two = codes[quote + 1], codes[np.minimum(quote + 2, n - 1)]
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for at, size in ((quote[single], 1), (quote[double & ~single], 2)):
        first[at + 1] = False
        first[at + 1 + size] = True
    return np.flatnonzero(first)


def _string(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _widths(codes: np.ndarray) -> np.ndarray:
    """Bytes of each character in UTF-8."""
    return 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)


class Encoder:
    """One per worker and vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.word = self._word_encoder(path)
        self._forget()

    def _word_encoder(self, path: str):
        ranks_path = path.removesuffix(".json") + ".tiktoken"
        if not os.path.exists(ranks_path):
            return lambda w: self.whole.encode(w, add_special_tokens=False).ids
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _forget(self) -> None:
        self.number: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.uint32)
        self.begin = np.zeros(1 << 16, dtype=np.int64)  # of a word's ids; the next entry is its end

    def _numbers(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of different words, encoding those that are new."""
        if len(self.number) + len(hashes) > KEPT_WORDS:
            self._forget()
        known = self.number
        out = np.fromiter((known.get(h, -1) for h in hashes.tolist()), dtype=np.int64, count=len(hashes))
        new = np.flatnonzero(out < 0)
        # " word" next to " word" is cut as each alone, so those are encoded as one text; the others one by one.
        joins = (codes[starts[new]] == 0x20) & (ends[new] - starts[new] > 1) & (tx.classes()[codes[np.minimum(starts[new] + 1, len(codes) - 1)]] == tx.LETTER)
        alone = [self.word(_string(codes[starts[i] : ends[i]])) for i in new[~joins].tolist()]
        new = np.concatenate([new[joins], new[~joins]])
        begin, size = starts[new[: joins.sum()]], (ends - starts)[new[: joins.sum()]]
        chars = codes[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        ids = np.array(self.word(_string(chars)), dtype=np.uint32)
        word_ends = np.cumsum(_widths(chars))[np.cumsum(size) - 1] if len(size) else np.zeros(0, dtype=np.int64)
        id_ends = np.searchsorted(np.cumsum(self.byte_lengths[ids]), word_ends) + 1
        found = np.concatenate([ids, np.array([i for w in alone for i in w], dtype=np.uint32)])
        id_ends = np.concatenate([id_ends, len(ids) + np.cumsum([len(w) for w in alone], dtype=np.int64)])
        count, used = len(known), int(self.begin[len(known)])
        if count + len(new) + 1 > len(self.begin):
            self.begin = np.concatenate([self.begin, np.zeros(max(len(self.begin), len(new) + 1), dtype=np.int64)])
        if used + len(found) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(found)), dtype=np.uint32)])
        self.begin[count + 1 : count + 1 + len(new)] = used + id_ends
        self.ids[used : used + len(found)] = found
        out[new] = np.arange(count, count + len(new))
        known.update(zip(hashes[new].tolist(), range(count, count + len(new))))
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's ids begin (one more entry for the end)."""
        codes, begins = tx.codes_of(texts)
        odd = ~np.logical_and.reduceat(_plain()[codes], begins[:-1]) if texts else np.zeros(0, dtype=bool)
        odd |= np.fromiter((SPECIAL in t for t in texts), dtype=bool, count=len(texts))
        starts = word_starts(codes)
        ends = np.append(starts[1:], len(codes))
        owner = np.searchsorted(begins, starts, side="right") - 1
        take = (codes[starts] != tx.END) & ~odd[owner]
        starts, ends, owner = starts[take], ends[take], owner[take]
        word, different = pd.factorize(tx.span_hashes(codes, starts, ends))
        at = np.zeros(len(different), dtype=np.int64)
        at[word[::-1]] = np.arange(len(word))[::-1]  # the first place of each word
        number = self._numbers(different, codes, starts[at], ends[at])[word]
        begin, size = self.begin[number], self.begin[number + 1] - self.begin[number]
        before = np.cumsum(size) - size
        ids = self.ids[np.repeat(begin - before, size) + np.arange(int(size.sum()))]
        counts = np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64)
        if odd.any():
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in np.flatnonzero(odd):
                parts[i] = np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, dtype=np.uint32)
                counts[i] = len(parts[i])
            ids = np.concatenate(parts)
        return ids, np.concatenate([[0], np.cumsum(counts)])

    @property
    def byte_lengths(self) -> np.ndarray:
        """Bytes that each id stands for."""
        if not hasattr(self, "_bytes"):
            shown = self.whole.get_vocab()
            self._bytes = np.zeros(max(shown.values()) + 1, dtype=np.int64)
            for token, i in shown.items():
                self._bytes[i] = len(token)  # this alphabet shows each byte as one character
            for i, token in self.whole.get_added_tokens_decoder().items():
                self._bytes[i] = len(token.content.encode())
        return self._bytes

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Character span [start, end) of each id; ids that share a character all span it."""
        wide = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        last = np.cumsum(self.byte_lengths[ids])
        if len(last) and last[-1] == len(wide):  # one byte a character
            return last - self.byte_lengths[ids], last
        byte_of = np.repeat(np.arange(len(wide)), _widths(wide))
        first = last - self.byte_lengths[ids]
        return byte_of[first], byte_of[last - 1] + 1


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
