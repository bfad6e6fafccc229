"""Whole texts to token ids, by the tokenizers library, with each word encoded once.

With a tokenizer that drops white space and never joins across it, a text's ids are the ids of its parts between spaces,
one after another. So a batch of texts is cut at spaces by Arrow, the distinct parts that have not been seen before are
encoded by the library, and the ids are gathered by numpy. Texts that hold ``<|`` (they may name a special token) are
encoded whole. Whether a tokenizer file is of this kind is read from its normaliser, pre-tokenizer, model and added
tokens; with any other, every text is encoded whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A letter that is a word of its own kind for the tokenizer, and marks that always start a new one after a letter.
LETTERS = "a-zß-öø-ÿ"
MARKS = "*&%$#!|.,;:?"


#: The normaliser and pre-tokenizer of the files whose words may be encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]}


def by_words(description: dict) -> bool:
    """Whether a tokenizer file's words may be encoded one by one."""
    model = description["model"]
    return (
        description.get("normalizer") == NORMALIZER and description.get("pre_tokenizer") == PRE_TOKENIZER and not description.get("post_processor")
        and not description.get("truncation") and not description.get("padding") and model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>"
        and not model.get("dropout") and all(t["content"].startswith("<|") and not t["lstrip"] and not t["rstrip"] for t in description["added_tokens"])
    )


def gather(pool: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The runs ``pool[starts[i] : starts[i] + lengths[i]]``, concatenated."""
    ends = np.cumsum(lengths, dtype=np.int64)
    total = int(ends[-1]) if len(ends) else 0
    index = np.arange(total, dtype=np.int64)
    index += np.repeat(starts - (ends - lengths), lengths)
    return pool[index]


class WordEncoder:
    """Encodes texts with a tokenizer file; with one whose words stand alone, keeps what it has encoded.

    ``max_bytes`` bounds the words kept; when they are more, all are forgotten.
    """

    def __init__(self, path: str, max_bytes: int = 24 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            self.by_words = by_words(json.load(f))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.max_bytes = max_bytes
        self._forget()

    def _forget(self) -> None:
        self.words = pa.array([], pa.string())
        self.pool = np.zeros(0, dtype=np.uint32)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)

    def _learn(self, words: pa.Array) -> None:
        plain = pc.match_substring_regex(words, f"^[{LETTERS}]+$")
        letters, others = words.filter(plain), words.filter(pc.invert(plain)).to_pylist()
        ids, lengths = [self.pool], [self.lengths]
        for at in range(0, len(letters), 20_000):
            part = letters.slice(at, 20_000).to_pylist()
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.ends_word[got]) + 1
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not end each word of letters with a word-end token")
            ids.append(got)
            lengths.append(np.diff(ends, prepend=0))
        for at in range(0, len(others), 5_000):
            for e in self.tokenizer.encode_batch_fast(others[at : at + 5_000], add_special_tokens=False):
                ids.append(np.array(e.ids, dtype=np.uint32))
                lengths.append(np.array([len(ids[-1])], dtype=np.int64))
        self.words = pa.concat_arrays([self.words, letters, pa.array(others, pa.string())])
        self.pool = np.concatenate(ids)
        self.lengths = np.concatenate(lengths).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets): text i has ids[offsets[i]:offsets[i + 1]]; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not self.by_words:
            pieces = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, dtype=np.uint32), *pieces]), np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        plain = pc.replace_substring(pc.ascii_lower(plain), "\n", " ")
        plain = pc.replace_substring_regex(plain, f"([{LETTERS}])([{MARKS}])", r"\1 \2")
        parts = pc.split_pattern(plain, " ")
        coded = parts.flatten().dictionary_encode()
        distinct = coded.dictionary
        known = pc.index_in(distinct, value_set=self.words)
        if known.null_count:
            if self.words.nbytes > self.max_bytes:
                self._forget()
                self._learn(distinct)
            else:
                self._learn(distinct.filter(known.is_null()))
            known = pc.index_in(distinct, value_set=self.words)
        word = known.to_numpy(zero_copy_only=False).astype(np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[word]
        ids = gather(self.pool, self.starts[word], lengths)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        cuts = parts.offsets.to_numpy().astype(np.int64)
        offsets = bounds[cuts - cuts[0]]
        if special.any():
            pieces = [ids[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            for i in np.flatnonzero(special):
                pieces[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, dtype=np.uint32)
            ids = np.concatenate(pieces)
            offsets = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        return ids, offsets


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, max_bytes: int = 24 << 20) -> WordEncoder:
    """The encoder of this Python worker for a tokenizer file and a bound of the words kept."""
    if (path, max_bytes) not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path, max_bytes] = WordEncoder(path, max_bytes)
    return _encoders[path, max_bytes]


def slices(texts: pa.Array, most: int = 8 << 20) -> list[tuple[int, int]]:
    """(start, length) of runs of rows of about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    return [(int(a), int(b - a)) for a, b in zip(starts, np.append(starts, len(sizes))[1:], strict=True)]
