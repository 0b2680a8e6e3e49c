"""Byte-pair encoding of many words at once, on arrays.

Gives the ids that the tokenizers library gives, for words of ASCII and Latin-1 letters, digits and punctuation; every
other word, and every tokenizer file of another kind, is left to the library. Tests hold the two against each other.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(2**31 - 1)
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: What a byte of UTF-8 is here: 0 not handled, 1 letter, 2 digit, 3 other visible ASCII, 4 space, 5 lead byte C3.
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[39] = 0  # an apostrophe starts pieces of its own
_KIND[32], _KIND[0xC3] = 4, 5


def byte_symbols() -> list[str]:
    """The visible character that stands for each byte: itself where it is visible Latin-1, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class ArrayBpe:
    """Merges of a byte-level vocabulary with word-end symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.usable = (
            model.get("type") == "BPE"
            and model.get("end_of_word_suffix") == "</w>"
            and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
            and [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and [p["type"] for p in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])] == ["Split", "ByteLevel"]
            and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": _SPLIT}
            and all(t["content"].startswith("<|") for t in spec["added_tokens"])
            and spec["post_processor"] is None
        )
        if not self.usable:
            return
        vocab = model["vocab"]
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.final = np.array([vocab[s + "</w>"] for s in symbols], np.int32)
        self.width = np.int64(max(vocab.values()) + 1)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int32)
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def split(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Lower-cased bytes of the words without spaces, each byte's word, the starts of pieces, and handled words."""
        buf = np.frombuffer(b" ".join(words) + b" ", np.uint8).copy()
        kind = _KIND[buf]
        space = kind == 4
        word = np.cumsum(space) - space
        lead = np.flatnonzero(kind == 5)
        after = buf[lead + 1]
        good = (after >= 0x80) & (after <= 0xBF) & (after != 0x97) & (after != 0xB7)
        kind[lead[good]] = kind[lead[good] + 1] = 1
        kind[lead[~good]] = 0
        buf[lead[good & (after <= 0x9E)] + 1] += 32
        buf[(buf >= 65) & (buf <= 90)] += 32
        bad = kind == 0
        bad[:-1] |= (buf[:-1] == 60) & (buf[1:] == 124)  # the start of a special token
        handled = np.ones(len(words), bool)
        handled[word[bad]] = False
        use = ~space & handled[word]
        buf, kind, word = buf[use], kind[use], word[use]
        start = np.ones(len(buf), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2) | (word[1:] != word[:-1])
        return buf, word, start, handled

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the handled words in order, how many each word has, and which words are handled."""
        buf, word, start, handled = self.split(words)
        if not len(buf):
            return np.empty(0, np.uint32), np.zeros(len(words), np.int64), handled
        last = np.append(start[1:], True)
        sym = np.where(last, self.final[buf], self.inner[buf])
        piece = np.cumsum(start) - 1
        of_word = word[start]
        rank = np.full(len(sym), _NONE)
        inside = np.flatnonzero(~last)
        rank[inside] = self._rank(sym[inside], sym[inside + 1])
        done_sym, done_piece = [], []
        while len(sym):
            first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            live = np.repeat(best != _NONE, size)
            if not live.all():
                done_sym.append(sym[~live])
                done_piece.append(piece[~live])
                sym, piece, rank = sym[live], piece[live], rank[live]
                if not len(sym):
                    break
                size, best = size[best != _NONE], best[best != _NONE]
            merge = rank == np.repeat(best, size)
            both = merge[1:] & merge[:-1]
            if both.any():  # a run of one symbol: its pairs overlap, every other one is merged
                i = np.arange(len(merge))
                run = i - np.maximum.accumulate(np.where(merge, -1, i)) - 1
                merge &= run % 2 == 0
            at = np.flatnonzero(merge)
            sym[at] = self.made[rank[at]]
            rank[at] = rank[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, piece, rank = sym[keep], piece[keep], rank[keep]
            at -= np.arange(len(at))
            changed = np.zeros(len(sym), bool)
            changed[at] = changed[at[at > 0] - 1] = True
            again = np.flatnonzero(changed[:-1])
            again = again[piece[again] == piece[again + 1]]
            rank[at] = _NONE
            rank[again] = self._rank(sym[again], sym[again + 1])
        sym, piece = np.concatenate(done_sym), np.concatenate(done_piece)
        order = np.argsort(piece, kind="stable")
        sizes = np.bincount(of_word[piece], minlength=len(words))
        return sym[order].astype(np.uint32), sizes, handled
