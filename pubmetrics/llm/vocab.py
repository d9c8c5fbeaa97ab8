"""Token ids of many texts: each distinct piece of text is encoded once, and its ids are then copied.

A piece never crosses a place where the tokenizer itself always splits, so the ids are those of the
whole text. Latin texts are split in numpy, all at once, by the classes of their code points; other
texts between white space. Pieces of a batch are brought together by 64-bit hashes and then compared; those
already encoded are known by their text.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from pubmetrics.llm import text as tx

#: Characters that tokenizers' patterns call white space.
SPACE = "\t-\r \x85\xa0  -     　"
#: Letters and numbers below U+0300; no marks that combine are there.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ˁˆ-ˑˠ-ˤˬˮ"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = 0x300
OTHER, LETTER, NUMBER, BLANK = 0, 1, 2, 3
CLASS = np.zeros(LATIN, np.int8)
for _class, _chars in ((LETTER, LETTERS), (NUMBER, NUMBERS), (BLANK, SPACE)):
    CLASS[[i for i in range(LATIN) if re.match(f"[{_chars}]", chr(i))]] = _class
#: U+0130 becomes two characters in lower case, so its texts go the other way.
NOT_LATIN = re.compile("[^\x00-įı-˿]")
LOWERED = np.array([ord(chr(i).lower()[0]) for i in range(LATIN)], np.uint32)
#: Of code points of one byte, which stay such.
LOWERED_BYTES = LOWERED[:256].astype(np.uint8)
#: For other texts: runs between white space, with one leading blank where it is kept.
WORDS = re.compile(f"[^{SPACE}]+")
PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: Bytes of pieces and ids that an encoder keeps between batches.
KEPT_BYTES = 1 << 27
ENCODED_AT_ONCE = 4096


def latin_pieces(chars: np.ndarray, offsets: np.ndarray, drops_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what the tokenizer splits Latin texts into."""
    n = len(chars)
    kind = CLASS[chars]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    new = edge[:-1].copy()
    new[1:] |= kind[1:] != kind[:-1]
    last = edge[1:]
    # 's 't 'm 'd 're 've 'll where an apostrophe starts a run, whatever follows.
    quote = np.flatnonzero((chars == 39) & new & ~last)
    if not drops_space:
        quote = quote[edge[quote] | (chars[quote - 1] != 32)]
    after = chars[quote + 1]
    one = quote[np.isin(after, [115, 116, 109, 100])]
    quote, after = quote[~last[np.minimum(quote + 1, n - 1)]], after[~last[np.minimum(quote + 1, n - 1)]]
    beyond = chars[quote + 2]
    two = quote[((after == 114) | (after == 118)) & (beyond == 101) | (after == 108) & (beyond == 108)]
    if drops_space:
        new |= kind == NUMBER
        starts_at = new & (kind != BLANK)
    else:
        starts_at = new.copy()
        starts_at[1:] &= edge[1:-1] | (chars[:-1] != 32) | (kind[1:] == BLANK)
        starts_at |= (kind == BLANK) & ~last & np.append(kind[1:] != BLANK, False)
    for at, size in ((one, 2), (two, 3)):
        starts_at[at + 1] = False
        rest = at + size
        rest = rest[rest < n]
        rest = rest[~edge[rest]]
        starts_at[rest[kind[rest] == LETTER]] = True
    starts = np.flatnonzero(starts_at)
    if drops_space:
        stop = starts_at | (kind == BLANK) | edge[:-1]
        stops = np.append(np.flatnonzero(stop), n)
        return starts, stops[np.searchsorted(stops, starts, side="right")]
    return starts, np.append(starts[1:], n)


class Encoder:
    """Ids of texts by a tokenizer file; ``drops_space`` for one whose ids leave white space and case out.

    Strings of special tokens in a text are ordinary text. Known pieces are kept until they and their ids take
    about ``most`` bytes (KEPT_BYTES unless given), then forgotten; a batch adds its own, so a worker holds that and one batch's.
    """

    def __init__(self, path: str, drops_space: bool, most: int | None = None):
        # A task has one core; the tokenizer's own threads would take others' and wait for each other.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.drops_space = drops_space
        self.most = KEPT_BYTES if most is None else most
        #: Whether an id ends a word, where each word has such an id, whatever its last byte.
        self.last: np.ndarray | None = None
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if drops_space and suffix:
            known = self.tokenizer.get_vocab(with_added_tokens=False)
            if all(c + suffix in known for c in pre_tokenizers.ByteLevel.alphabet()):
                self.last = np.zeros(max(known.values()) + 1, bool)
                self.last[[i for token, i in known.items() if token.endswith(suffix)]] = True
        self.forget()

    def forget(self) -> None:
        self.slots: dict[str, int] = {}
        self.kept = 0
        #: Ids of slot i: ids[starts[i] : starts[i + 1]].
        self.starts = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)

    def add(self, pieces: list[str], words: bool) -> None:
        # The tokenizer's results take far more than their ids, so a bounded number of pieces at a time.
        for at in range(0, len(pieces), ENCODED_AT_ONCE):
            self.add_some(pieces[at : at + ENCODED_AT_ONCE], words)

    def ids_of(self, pieces: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """All ids of pieces in a row, and their number for each piece."""
        if words and self.last is not None:
            # One text takes half the time of as many as there are pieces; white space always splits, and leaves no id.
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[found]) + 1
            if len(ends) == len(pieces) and ends[-1] == len(found):
                return found, np.diff(ends, prepend=0)
        single = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, single), np.int64, len(single))
        return np.fromiter(chain.from_iterable(single), np.uint32, int(counts.sum())), counts

    def add_some(self, pieces: list[str], words: bool) -> None:
        found, counts = self.ids_of(pieces, words)
        n, used = len(self.slots), int(self.starts[len(self.slots)])
        ends = used + np.cumsum(counts)
        if n + len(pieces) >= len(self.starts):
            self.starts = np.append(self.starts, np.zeros(len(self.starts) + len(pieces), np.int64))
        if ends[-1] > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(len(self.ids) + len(found), np.uint32))
        self.starts[n + 1 : n + 1 + len(pieces)] = ends
        self.ids[used : ends[-1]] = found
        self.slots.update(zip(pieces, range(n, n + len(pieces))))
        # A piece is a string object (up to four bytes a character), an entry of the dictionary and its ids.
        self.kept += 160 * len(pieces) + 4 * sum(map(len, pieces)) + 4 * len(found)

    def slots_of(self, pieces: list[str], words: bool = False) -> np.ndarray:
        """Slots of pieces, the unknown ones encoded first; ``words``: the tokenizer splits none of them further."""
        found = np.fromiter(map(self.slots.get, pieces, repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(found < 0)
        if len(new):
            fresh = [pieces[i] for i in new.tolist()]
            self.add(list(dict.fromkeys(fresh)), words)
            found[new] = np.fromiter(map(self.slots.__getitem__, fresh), np.int64, len(fresh))
        return found

    def latin_slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "".join(texts)
        offsets = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        try:  # nearly always one byte a character
            coding, kind, lowered = "latin-1", np.uint8, LOWERED_BYTES
            raw = joined.encode(coding)
        except UnicodeEncodeError:
            coding, kind, lowered = "utf-32-le", np.uint32, LOWERED
            raw = joined.encode(coding)
        chars = np.frombuffer(raw, kind)
        if self.drops_space:
            chars = lowered[chars]
            joined = chars.tobytes().decode(coding)
        starts, ends = latin_pieces(chars, offsets, self.drops_space)
        spans = tx.Blocks(chars if kind is np.uint8 else chars.astype(np.uint16), starts, ends)
        which = pa.array(spans.hashes()).dictionary_encode().indices.to_numpy()
        where = np.zeros(int(which.max()) + 1 if len(which) else 0, np.int64)
        where[which[::-1]] = np.arange(len(which))[::-1]  # the first piece of each hash
        slots = self.slots_of([joined[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist())], True)[which]
        # Pieces that met others by hash only.
        odd = np.flatnonzero(~spans.same(np.arange(len(starts)), where[which]))
        if len(odd):
            slots[odd] = self.slots_of([joined[a:b] for a, b in zip(starts[odd].tolist(), ends[odd].tolist())], True)
        return slots, np.searchsorted(starts, offsets)

    def other_slots(self, text: str) -> np.ndarray:
        pieces = (WORDS if self.drops_space else PIECES).findall(text)
        return self.slots_of(pieces)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column in a row, and offsets of its texts; a null text has none."""
        if self.kept > self.most:
            self.forget()
        texts = [t or "" for t in column.to_pylist()]
        odd = [i for i, t in enumerate(texts) if not t.isascii() and NOT_LATIN.search(t)]
        others = set(odd)
        slots, first = self.latin_slots([t if i not in others else "" for i, t in enumerate(texts)] if odd else texts)
        if odd:
            rows = np.split(slots, first[1:-1])
            for i in odd:
                rows[i] = self.other_slots(texts[i])
            slots, first = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        counts = self.starts[slots + 1] - self.starts[slots]
        at = np.concatenate([[0], np.cumsum(counts)])
        return self.ids[tx.ranges(self.starts[slots], counts)], at[first]


_ENCODERS: dict[tuple[str, bool, int], Encoder] = {}


def encoder(path: str, drops_space: bool, most: int = KEPT_BYTES) -> Encoder:
    """One encoder for each Python worker."""
    if (path, drops_space, most) not in _ENCODERS:
        _ENCODERS[path, drops_space, most] = Encoder(path, drops_space, most)
    return _ENCODERS[path, drops_space, most]


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """An end id after each text's ids."""
    return np.insert(ids, offsets[1:], np.uint32(end)), offsets + np.arange(len(offsets))
