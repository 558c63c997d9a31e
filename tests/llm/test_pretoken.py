from __future__ import annotations

import public_tokenizers

from quillsift.llm import packing, pretoken


def test_packing_encodes_more_words_once_than_the_default_cache_holds():
    encoder = packing.byte_level_encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.latin.clear()
    words = [f"{n:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for n in range(pretoken.CACHE_WORDS + 50_000)]
    whole, seen = encoder.latin.encode, []
    encoder.latin.encode = lambda word: seen.append(word) or b"\0\0\0\0"
    try:
        for _ in range(2):
            encoder(",".join(words))
        assert len(seen) == len(set(seen))
    finally:
        encoder.latin.encode = whole
        encoder.latin.clear()
