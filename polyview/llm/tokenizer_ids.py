"""Ids of whole texts under a byte-level BPE tokenizer file of the tokenizers library.

The file is read with the tokenizers library.  Its ids are merge ranks, so the ids of a text follow from the
ranks alone and are computed by tiktoken's rank merger, which is three times as fast as the
library's own encoder.  Added tokens (such as ``<|endoftext|>``) that stand in a text get their own id, and the text around
them is encoded piece by piece, as the library does; tests hold whole texts with such tokens against an unmodified tokenizer.
A file with rules beyond these (a normaliser, a prefix space, added tokens that swallow white space) is
encoded by the library itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import numpy as np

#: The GPT-2 splitting pattern in possessive form: the same pieces, without backtracking.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encoders: dict[str, Callable[[str], np.ndarray]] = {}


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level BPE files write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _is_plain(tokenizer) -> bool:
    """Whether the file's rules are merges by rank over the splitting pattern, and added tokens as they stand."""
    rules = json.loads(tokenizer.to_str())
    before, model = rules["pre_tokenizer"] or {}, rules["model"]
    if rules["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return False
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in rules["added_tokens"])


def text_encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids (none added at its ends); one per worker process and file."""
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        tokenizer, alphabet = Tokenizer.from_file(path), byte_alphabet()
        if not _is_plain(tokenizer):
            _encoders[path] = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            return _encoders[path]
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.content}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in tokenizer.get_vocab(False).items() if token not in added}
        encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        plain = lambda text: encoding.encode_to_numpy(text, disallowed_special=())
        # the longest added token wins where two begin at one place
        cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None

        def encode(text: str) -> np.ndarray:
            if cut is None or cut.search(text) is None:
                return plain(text)
            parts = cut.split(text)
            return np.concatenate([np.array([added[p]], np.uint32) if k % 2 else plain(p) for k, p in enumerate(parts)])

        _encoders[path] = encode
    return _encoders[path]
