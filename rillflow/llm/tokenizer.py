"""Whole-text encoding with a byte-level BPE file of the tokenizers library, each distinct piece of a batch once.

The file's pre-tokenizer cuts a text into pieces, and merges never cross pieces. Here numpy finds the
edges of all pieces of a batch of texts from the class of each character (letter, number, white space,
other); the library's model then encodes the distinct pieces, and their ids are gathered in the order
of the texts. Classes come from the library's own pre-tokenizer, asked once for each character seen.
Nothing is kept between batches but these classes, so memory is bounded by BATCH characters.

Files with another pre-tokenizer or a normalizer, and texts that hold a special token's string, are
encoded by plain calls.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

BATCH = 2 << 20  # characters encoded at once; longer texts are cut where a piece starts
STARTS = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
DIVIDER = "\n"  # not a character that stands for a byte
# What the pre-tokenizer divides from letters after an apostrophe.
SUFFIXES = ["s", "t", "re", "ve", "m", "ll", "d"]
_encoders: dict[str, "Encoder"] = {}


def byte_characters() -> str:
    """The characters that stand for bytes 0 to 255: printable ones for themselves, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class Encoder:
    """Ids of texts as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        pre, letters, vocabulary = self.tokenizer.pre_tokenizer, byte_characters(), self.tokenizer.get_vocab(with_added_tokens=False)
        self.by_pieces = self.tokenizer.normalizer is None and pre is not None and json.loads(pre.__getstate__()) == BYTE_LEVEL and all(c in vocabulary for c in letters)
        if self.by_pieces:
            self.model = Tokenizer(self.tokenizer.model)  # the same model, not a second copy
            self.model.pre_tokenizer = CharDelimiterSplit(DIVIDER)
            self.letters = np.array([ord(c) for c in letters], "<u2")
            self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id
            self.sizes[list(vocabulary.values())] = [len(token) for token in vocabulary]
            self.classes = np.zeros(0x110000, np.uint8)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _class(self, character: str) -> int:
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for kind, like in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")):
            if len(pieces(like + character)) == 1:
                return kind
        return SPACE

    def _edges(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces start in the code points of texts, one after another, that begin where `first` is set."""
        kinds = self.classes[points]
        if not kinds.all():
            for point in np.unique(points[kinds == 0]).tolist():
                self.classes[point] = self._class(chr(point))
            kinds = self.classes[points]
        edge = first.copy()
        edge[1:-1] |= kinds[1:] != kinds[:-1]
        space = kinds == SPACE
        last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:-1])  # white space before something else
        edge[last] = True
        edge[last[points[last] == ord(" ")] + 1] = False  # a space belongs to what follows it
        at = np.flatnonzero(points == ord("'"))
        at = at[edge[at]]
        for suffix in SUFFIXES if len(at) else ():
            own = at[at + len(suffix) < len(points)]
            for k, c in enumerate(suffix, 1):
                own = own[(points[own + k] == ord(c)) & ~first[own + k]]
            edge[own + 1] = False
            edge[own + 1 + len(suffix)] = True
        return np.flatnonzero(edge[:-1])

    def _model_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pieces, one piece after another, and how many each has."""
        n = len(pieces)
        ends = np.frombuffer(pieces.buffers()[1], np.int32, n + 1)
        data = np.frombuffer(pieces.buffers()[2], np.uint8, ends[-1])
        text = np.full(len(data) + n, ord(DIVIDER), "<u2")
        text[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(ends))] = self.letters[data]
        ids = np.array(self.model.encode_batch_fast([text.tobytes().decode("utf-16-le")], add_special_tokens=False)[0].ids, "<u4")
        reached = np.cumsum(self.sizes[ids])
        last = np.searchsorted(reached, ends[1:])
        if last[-1] != len(ids) - 1 or (reached[last] != ends[1:]).any():
            raise ValueError("the ids of the pieces don't give back their bytes")
        return ids, np.diff(last, prepend=-1)

    def _batch(self, texts: list[str]) -> list[bytes]:
        """Texts that aren't empty."""
        joined = "".join(texts)
        data, points = joined.encode(), np.frombuffer(joined.encode("utf-32-le"), "<u4")
        starts = np.cumsum([0, *map(len, texts)])
        first = np.zeros(len(points) + 1, bool)
        first[starts[:-1]] = True
        edges = self._edges(points, first)
        own = np.append(np.searchsorted(edges, starts[:-1]), len(edges))
        if len(data) > len(points):
            width = (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF) + 1
            edges = (np.cumsum(width) - width)[edges]
        offsets = np.append(edges, len(data)).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(edges), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        ids, counts = self._model_ids(coded.dictionary)
        which = coded.indices.to_numpy()
        n = counts[which]
        at = np.concatenate([[0], np.cumsum(n)])
        ids = ids[np.repeat((np.cumsum(counts) - counts)[which] - at[:-1], n) + np.arange(at[-1])].tobytes()
        bounds = (4 * at[own]).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]

    def encode(self, text: str) -> bytes:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Null is encoded as the empty text."""
        out: list[list[bytes]] = [[] for _ in texts]
        batch, size = [], 0

        def flush():
            for (i, _), ids in zip(batch, self._batch([t for _, t in batch]) if batch else ()):
                out[i].append(ids)
            batch.clear()

        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_pieces or any(s in text for s in self.special):
                out[i].append(self._plain(text))
                continue
            a = 0
            while a < len(text):
                cut = STARTS.search(text, a + BATCH) if len(text) - a > BATCH else None
                b = cut.start() if cut else len(text)
                batch.append((i, text[a:b]))
                a, size = b, size + b - a
                if size >= BATCH:
                    flush()
                    size = 0
        flush()
        return [b"".join(parts) for parts in out]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
