"""Token ids of whole texts by a tokenizer file of the tokenizers library, many texts at a time.

The tokenizer splits texts at white space, and never lets a match of its word pattern run from an ASCII letter into ASCII
punctuation. So a batch of texts is cut there, each different piece goes through the library once, and the ids of the
texts are gathered from those of the pieces. Pieces keep every character that is not white space; what the library does
with case and composed characters it does within a piece. Texts that may hold the name of an added token, which the library
finds before it splits anything, go through it whole.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The id that ends each document.
END = 1
#: Pieces whose ids a worker keeps for later batches.
KEPT_PIECES = 200_000
#: Bytes of text that are worked on at once; a longer text is worked on alone.
BATCH_BYTES = 4 << 20

_KIND = np.zeros(256, np.uint8)  # 1 white space, 2 ASCII letter, 3 ASCII punctuation but for ', 4 ', 0 all else
_KIND[[9, 10, 11, 12, 13, 32]] = 1
_KIND[[*range(65, 91), *range(97, 123)]] = 2
_KIND[[x for x in range(33, 127) if not chr(x).isalnum()]] = 3
_KIND[ord("'")] = 4
#: Words of a-z, and the small Latin-1 letters, in UTF-8.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch
_LOWER = np.zeros(256, np.uint8)
_LOWER[65:91] = 32


class Encoder:
    """Encodes batches of texts, as the library does with add_special_tokens=False: the name of an added token in a text is
    that token."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # What an added token's name begins with up to its first letter, or the whole name: texts without any hold none.
        names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = sorted({re.match(r"[^\w\s]{2,}", n)[0] if re.match(r"[^\w\s]{2,}", n) else n for n in names})
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.known: dict[bytes, bytes] = {}
        # Lower-case words of these letters pass normalization unchanged and are one match of the word pattern each: many
        # of them, apart by spaces, go through the model at once, and ids of tokens that end a word part them again.
        self.words = Tokenizer.from_file(path)
        suffix = getattr(self.words.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.vocabulary, bool)
        if suffix:
            self.ends[[i for token, i in self.words.get_vocab().items() if token.endswith(suffix)]] = True
            self.words.normalizer = None
            self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def pieces(self, unique: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        known = self.known
        new = [x for x in unique if x not in known]
        if len(known) + len(new) > KEPT_PIECES:
            known.clear()
            new = unique
        plain = [x for x in new if _PLAIN(x)] if self.ends.any() else []
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = np.array(self.words.encode_batch_fast([b" ".join(part).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops = np.append(0, 4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(stops) == len(part) + 1:
                raw = ids.tobytes()
                known.update(zip(part, (raw[a:b] for a, b in zip(stops[:-1], stops[1:], strict=True)), strict=True))
        new = [x for x in new if x not in known]
        for at in range(0, len(new), 50_000):
            part = new[at : at + 50_000]
            found = self.tokenizer.encode_batch_fast([x.decode() for x in part], add_special_tokens=False)
            known.update(zip(part, (array("I", x.ids).tobytes() for x in found), strict=True))
        own = [known[x] for x in unique]
        return np.frombuffer(b"".join(own), "<u4"), np.fromiter(map(len, own), np.int64, len(own)) // 4

    def encode(self, texts: pa.StringArray, end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 places where texts begin. Null is the empty text."""
        marked = np.zeros(len(texts), bool)
        for mark in self.marks:
            marked |= pc.fill_null(pc.match_substring(texts, mark, ignore_case=True), False).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._by_pieces(texts, end)
        ids, places = self._by_pieces(pc.if_else(pa.array(marked), "", texts), end)
        extra = [] if end is None else [end]
        whole = iter(x.ids for x in self.tokenizer.encode_batch_fast(texts.filter(pa.array(marked)).to_pylist(), add_special_tokens=False))
        parts = [np.array([*next(whole), *extra], np.uint32) if m else ids[a:b] for m, a, b in zip(marked.tolist(), places[:-1].tolist(), places[1:].tolist(), strict=True)]
        return np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts], dtype=np.int64))

    def _by_pieces(self, texts: pa.StringArray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        n = len(texts)
        texts = texts.cast(pa.large_binary())
        bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        if n and texts.null_count:
            valid = texts.is_valid()
            texts = pc.fill_null(texts, b"")
            assert len(valid) == n
            bounds = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]] if n else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        if not len(data):
            ends = np.arange(n + 1, dtype=np.int64) if end is not None else np.zeros(n + 1, np.int64)
            return np.full(n if end is not None else 0, end or 0, np.uint32), ends
        kind = _KIND[data]
        body = kind != 1
        starts = np.zeros(len(data), bool)
        starts[bounds[:-1][bounds[:-1] < len(data)]] = True
        before, now = kind[:-1], kind[1:]
        starts[1:] |= (before == 1) | ((before == 2) & (now >= 3)) | ((before == 3) & (now == 2))
        starts &= body
        # A text that begins with white space: its first piece begins where that ends, which follows from the rule above.
        plain = np.ones(len(data), bool)
        plain[:-1] = data[1:] < 128  # a mark that follows could make another letter of it
        data = np.where(plain, data + _LOWER[data], data)[body]
        at = np.cumsum(body, dtype=np.int64)  # bytes kept up to and with each byte
        places = at[starts] - 1
        keys = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(places), [None, pa.py_buffer(np.append(places, len(data)).astype("<i8")), pa.py_buffer(np.ascontiguousarray(data))])
        coded = keys.dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        flat, sizes = self.pieces(coded.dictionary.to_pylist())
        begins = np.cumsum(sizes) - sizes
        own = sizes[index]
        # Pieces before each text, and so ids before it.
        first = np.append(0, np.cumsum(starts, dtype=np.int64))[bounds]
        upto = np.append(0, np.cumsum(own))
        extra = 0 if end is None else 1
        places = upto[first] + extra * np.arange(n + 1)
        ids = np.full(places[-1], end or 0, np.uint32)
        source = np.repeat(begins[index] - upto[:-1], own) + np.arange(upto[-1])
        if extra:
            hole = np.ones(places[-1], bool)
            hole[places[1:] - 1] = False
            ids[hole] = flat[source]
        else:
            ids[:] = flat[source]
        return ids, places


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(batch: pa.RecordBatch, column: str):
    """The batch in slices of about BATCH_BYTES of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // BATCH_BYTES
    cuts = np.append(np.append(0, np.flatnonzero(np.diff(group)) + 1), len(sizes)) if len(sizes) else np.zeros(1, int)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield batch.slice(a, b - a)
