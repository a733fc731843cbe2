"""Token ids of whole texts under a `tokenizers` file.

For byte-level BPE files (no normaliser, plain byte-level splitting, no post-processing) the
ids are computed by the same merges in `tiktoken`, several times faster; a text that holds a
special token's string, or characters whose class differs between Unicode versions, goes to the
`tokenizers` library itself, as does every text under any other kind of file. So the ids are
always those of that library, with special strings in texts handled as its default.

Edge cases: null and empty texts have no ids; length is not limited.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from .pretoken import BYTE_LEVEL, settled


def read_tokenizer(path: str) -> str:
    """A `tokenizers` file's JSON, read on the driver."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def byte_chars() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the rest by characters from U+0100 on, in order of the bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def specials(config: dict) -> list[str]:
    """Strings that the tokenizer takes out of a text before anything else."""
    return [x["content"] for x in config.get("added_tokens") or []]


def is_byte_level(config: dict) -> bool:
    """Whether the file is byte-level BPE in its plain form."""
    pre, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    plain = not any(config.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
    odd = any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return plain and not odd and model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")


def library(text: str):
    """The `tokenizers` object, without truncation, padding or threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_str(text)
    out.no_truncation()
    out.no_padding()
    return out


_worker: dict = {}


def ids_for(data: str) -> Callable[[str], list[int]]:
    """This worker's function from a text to its ids; `data`: the tokenizer file's JSON."""
    key = (hash(data), len(data))
    if key in _worker:
        return _worker[key]
    config, tokenizer = json.loads(data), library(data)

    def slow(text: str) -> list[int]:
        return tokenizer.encode(text, add_special_tokens=False).ids

    fast = slow
    if is_byte_level(config):
        import tiktoken

        of, marks = byte_chars(), specials(config)
        ranks = {bytes(of[c] for c in t): i for t, i in config["model"]["vocab"].items() if t not in marks}
        plain = tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

        def fast(text: str) -> list[int]:
            return plain(text) if settled(text) and not any(m in text for m in marks) else slow(text)

    _worker.clear()
    _worker[key] = fast
    return fast
