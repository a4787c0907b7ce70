"""Token ids of whole texts by a given tokenizer file, with each distinct word encoded once per task.

Both supported kinds of tokenizer cut a text before encoding, so that what stands between two cuts gets the same ids in
any text. A single space or line feed between two other characters is always such a cut, and so is the place between a
letter and ASCII punctuation. Pieces between cuts are encoded by the tokenizers library once and remembered. Where spaces
are kept, a text with other spacing goes to the library whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from feedforge.llm.words import ranges

#: Pieces that are remembered; beyond it the memory starts anew.
REMEMBERED = 400_000

_STEM_AND_TAIL = re.compile(r"(.*[^\W\d_])([!-&(-/:-@\[-`{-~]+)", re.DOTALL)


_TAILS = frozenset(chr(c) for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def _oddly_spaced(text: str) -> bool:
    """Whether white space is anything but single spaces and line feeds inside the text."""
    return len(text.split()) != text.count(" ") + text.count("\n") + 1


class _Memory(dict):
    """Piece to number; a new piece gets the next number and is listed for encoding."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class _Growing:
    """An array that is appended to in place; its room doubles, so that a value is copied a bounded number of times."""

    def __init__(self, dtype: type):
        self.room, self.size = np.zeros(0, dtype), 0

    def append(self, values: np.ndarray) -> None:
        size = self.size + len(values)
        if size > len(self.room):
            room = np.empty(max(size, 2 * len(self.room)), self.room.dtype)
            room[: self.size] = self.room[: self.size]
            self.room = room
        self.room[self.size : size] = values
        self.size = size

    @property
    def values(self) -> np.ndarray:
        return self.room[: self.size]


class _Pieces:
    """Ids of numbered pieces: where each one's begin in a common array, and how many they are."""

    def __init__(self):
        self.memory = _Memory()
        self.begins, self.counts, self.ids = _Growing(np.int64), _Growing(np.int64), _Growing(np.int32)
        self.tails = _Memory()
        self.tail_ids, self.tail_ends = _Growing(np.int32), [0]

    def learn(self, encode, encode_pieces) -> None:
        """Find the ids of the new pieces; those made of a known stem and a tail are put together from these."""
        if not self.memory.new:
            return
        first = self.begins.size
        made, stems, tails = [], [], []
        for number, piece in enumerate(list(self.memory.new)):
            if piece[-1:] in _TAILS and "<|" not in piece and (cut := _STEM_AND_TAIL.fullmatch(piece)):
                made.append(number)
                stems.append(self.memory[cut[1]])
                tails.append(self.tails[cut[2]])
        if self.tails.new:
            for x in encode(self.tails.new, add_special_tokens=False):
                self.tail_ids.append(np.array(x.ids, np.int32))
                self.tail_ends.append(self.tail_ids.size)
            self.tails.new.clear()
        new = self.memory.new
        whole = np.ones(len(new), bool)
        whole[made] = False
        begins, counts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        ids, begins[whole], counts[whole] = encode_pieces([new[n] for n in np.flatnonzero(whole).tolist()])
        begins += self.ids.size
        self.ids.append(ids)
        self.begins.append(begins)
        self.counts.append(counts)
        new.clear()
        if made:
            ends = np.array(self.tail_ends)
            n_stem, n_tail = self.counts.values[stems], np.diff(ends)[tails]
            total = n_stem + n_tail
            starts = np.cumsum(total) - total
            ids = np.empty(int(total.sum()), np.int32)
            ids[ranges(starts, n_stem)] = self.ids.values[ranges(self.begins.values[stems], n_stem)]
            ids[ranges(starts + n_stem, n_tail)] = self.tail_ids.values[ranges(ends[tails], n_tail)]
            at = first + np.array(made)
            self.begins.values[at], self.counts.values[at] = self.ids.size + starts, total
            self.ids.append(ids)


def _one_word(piece: str) -> bool:
    return piece.isalpha() and (piece.isascii() or len(piece.lower()) == len(piece))


class Encoder:
    """Encodes lists of texts to one array of ids with ``end_id`` after each text.

    ``path``: a tokenizers file. ``spaces_dropped``: whether it ignores white space (else a space belongs to the word
    after it). Special tokens are not added.
    """

    def __init__(self, path: str, spaces_dropped: bool, end_id: int = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_batch = tokenizer.encode_batch_fast
        edge = np.zeros(tokenizer.get_vocab_size(), bool)
        for token, number in tokenizer.get_vocab().items():
            edge[number] = token.endswith("</w>") if spaces_dropped else token.startswith("\u0120")
        self.edge = edge
        self.spaces_dropped, self.end_id = spaces_dropped, end_id
        self.clear()

    def clear(self) -> None:
        self.first, self.rest = _Pieces(), _Pieces()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's ids begin (one entry more)."""
        if len(self.first.memory) + len(self.rest.memory) > REMEMBERED:
            self.clear()
        plain, whole = [], {}
        for number, text in enumerate(texts):
            if not self.spaces_dropped and _oddly_spaced(text):
                whole[number] = text
                plain.append(None)
            elif self.spaces_dropped:
                pieces = text.replace("\n", " ").split(" ")
                plain.append(np.fromiter(map(self.rest.memory.__getitem__, pieces), np.int64, len(pieces)))
            else:
                head, *pieces = text.replace("\n", " \n").split(" ")
                numbers = np.empty(len(pieces) + 1, np.int64)
                numbers[0] = -1 - self.first.memory[head]
                numbers[1:] = np.fromiter(map(self.rest.memory.__getitem__, pieces), np.int64, len(pieces))
                plain.append(numbers)
        self.first.learn(self.encode_batch, self._ids_of_heads)
        self.rest.learn(self.encode_batch, self._ids_of_pieces)
        if whole:
            found = self.encode_batch(list(whole.values()), add_special_tokens=False)
            whole = {n: np.array(x.ids, np.int32) for n, x in zip(whole, found, strict=True)}
        out, lengths = [], np.zeros(len(texts) + 1, np.int64)
        end = np.array([self.end_id], np.int32)
        for number, numbers in enumerate(plain):
            ids = whole[number] if numbers is None else self._gathered(numbers)
            out += [ids, end]
            lengths[number + 1] = len(ids) + 1
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.cumsum(lengths)

    def _ids_of_heads(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return _one_by_one([x.ids for x in self.encode_batch(pieces, add_special_tokens=False)])

    def _ids_of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, where each piece's begin and how many they are.

        Most are encoded many at once and told apart by the tokens that end or begin a word.
        """
        begins, counts = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        alone, joined = [], []
        for number, piece in enumerate(pieces):
            plain = _one_word(piece) if self.spaces_dropped else piece and piece[0] != "\n" and "<|" not in piece
            (joined if plain else alone).append(number)
        lots = [joined[at : at + 500] for at in range(0, len(joined), 500)]
        texts = [" " + " ".join([pieces[n] for n in lot]) for lot in lots]
        out, size = [], 0
        for lot, made in zip(lots, self.encode_batch(texts, add_special_tokens=False), strict=True):
            ids = np.array(made.ids, np.int32)
            edges = np.flatnonzero(self.edge[ids])
            if len(edges) != len(lot):
                alone += lot
                continue
            begins[lot] = size + (np.append(0, edges[:-1] + 1) if self.spaces_dropped else edges)
            counts[lot] = np.diff(edges, prepend=-1) if self.spaces_dropped else np.diff(edges, append=len(ids))
            out.append(ids)
            size += len(ids)
        space = "" if self.spaces_dropped else " "
        texts = [pieces[n] if pieces[n][:1] == "\n" else space + pieces[n] for n in alone]
        ids, own, counts[alone] = _one_by_one([x.ids for x in self.encode_batch(texts, add_special_tokens=False)])
        begins[alone] = size + own
        return np.concatenate([*out, ids]), begins, counts

    def _gathered(self, numbers: np.ndarray) -> np.ndarray:
        head = np.zeros(0, np.int32)
        if len(numbers) and numbers[0] < 0:
            n = -1 - numbers[0]
            begin = self.first.begins.values[n]
            head, numbers = self.first.ids.values[begin : begin + self.first.counts.values[n]], numbers[1:]
        ids = self.rest.ids.values[ranges(self.rest.begins.values[numbers], self.rest.counts.values[numbers])]
        return np.concatenate([head, ids]) if len(head) else ids


def _one_by_one(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids of ``found``, where each list's begin and its length."""
    counts = np.fromiter(map(len, found), np.int64, len(found))
    ids = np.concatenate([np.array(x, np.int32) for x in found]) if found else np.zeros(0, np.int32)
    return ids, np.cumsum(counts) - counts, counts


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, spaces_dropped: bool, end_id: int = 1) -> Encoder:
    """One encoder per Python worker, so that tasks after the first find its memory filled."""
    key = (path, spaces_dropped, end_id)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
