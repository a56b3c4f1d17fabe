"""Encoding of Arrow batches of texts to token ids with the tokenizers library, pre-token by pre-token."""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import flat
from .pretokens import Memo, split


class BatchEncoder:
    """Ids as the tokenizers library gives them for whole texts, add_special_tokens=False.

    Only pre-tokens that this worker has not met go through the library; the split is done in numpy. Texts with characters outside the
    stable Unicode ranges, and those that hold one of the vocabulary's special strings, go through the library as a whole.
    special_strings: such a string in a text is its own id, the library's default; else it is ordinary text.
    """

    def __init__(self, path: str, rule: str, special_strings: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special_strings
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.rule = rule
        self.memo = Memo(lambda words: self.whole([w.decode("utf-8") for w in words]))

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids, `end` after each text if given, and the place of each text's first id (one more at the end)."""
        whole, exact = texts, set()
        for special in self.special:
            exact.update(np.flatnonzero(pc.fill_null(pc.match_substring(whole, special), False).to_numpy(zero_copy_only=False)).tolist())
        if self.rule == "plain":
            values = [x or "" for x in texts.to_pylist()]
            exact.update(i for i, x in enumerate(values) if "Σ" in x or "İ" in x)
            texts = pa.array([unicodedata.normalize("NFC", x).lower() for x in values], pa.string())
        buf, offsets = flat(texts)
        begins, ends, first, unsure = split(buf, offsets, self.rule)
        ids, place = self.memo.spread(self.memo.entries(buf, begins, ends))
        place = place[first]
        slow = sorted({*unsure.tolist(), *exact})
        if not slow and end is None:
            return ids, place
        swap = dict(zip(slow, self.whole([x or "" for x in whole.take(pa.array(slow)).to_pylist()]))) if slow else {}
        sizes = np.diff(place)
        parts, at = [], 0
        if swap:
            for i in slow:
                parts += [ids[place[at] : place[i]], np.array(swap[i], np.int32)]
                sizes[i], at = len(swap[i]), i + 1
            ids = np.concatenate([*parts, ids[place[at] : place[-1]]])
        place = np.concatenate([[0], np.cumsum(sizes)])
        if end is not None:
            ids = np.insert(ids, place[1:], end)
            place = place + np.arange(len(place))
        return ids, place


@lru_cache(4)
def encoder(path: str, rule: str) -> BatchEncoder:
    """One for each Python worker, kept between tasks."""
    return BatchEncoder(path, rule)
