import numpy as np
import pytest

from statuta.llm import simple8b
from statuta.llm.token_files import WordEncoder, default_tokenizer, pack_segment, unpack_segment


@pytest.mark.parametrize("high", [2, 100, 49_408, 1 << 32, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 59, 4095, 4096, 4097, 20_000])
def test_round_trip(high, n):
    rng = np.random.default_rng(n)
    values = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
    values[: n // 3] %= 3
    words, offsets, escapes = simple8b.encode(values)
    assert (simple8b.decode(words, offsets, escapes, n) == values).all()
    if n > 4097:
        assert (simple8b.decode(words, offsets, escapes, n, 1, 2) == values[4096 : 3 * 4096]).all()


def test_segment_is_checked():
    raw = pack_segment([None, 5], [1, 2], np.array([1, 7, 1]))
    ids, counts, values = unpack_segment(raw)
    assert (ids, counts.tolist(), values.tolist()) == ([None, 5], [1, 2], [1, 7, 1])
    with pytest.raises(ValueError):
        unpack_segment(raw[:-9] + b"x" + raw[-8:])


def test_words_encode_as_the_library_does():
    from tokenizers import Tokenizer

    whole, enc = Tokenizer.from_file(default_tokenizer()), WordEncoder(default_tokenizer(), max_words=40)
    texts = ["", " ", "It's a test. ÉTÉ, über\tnée\r\nx", "a b c d\x1ce", "<|endoftext|> end<|startoftext|>x", "1,234.5 abc... don't we'll ΟΔΟΣ ΣΑΣ. İstanbul ß ẞ 日本語 🙂🙂 ́x", "x" * 3000, "Straße naïve. Œuvre ÿ Þ × ÷a"]
    for text in texts:
        assert enc.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_pieces_are_encoded_once():
    """Stops, signs and capitals make no new pieces; odd words, special tokens and white space give the library's ids; the memory is bounded and keeps what is in use."""
    from tokenizers import Tokenizer

    whole, enc = Tokenizer.from_file(default_tokenizer()), WordEncoder(default_tokenizer())
    enc.encode("Übung übung. ÜBUNG### (übung), übung... #übung%%% übung7")
    asked = len(enc.pieces)
    assert asked == 9 and not enc.words
    texts = ["it's o'clock 's", "a<|endoftext|>b <|ENDOFTEXT|>", "x́≮ a\xa0b\x85c \x1f", "ΟΔΟΣ. İi ǅ", "½²×÷ªºµ ß", "a\tb\r\nc", "10.5%-90 a1b2'c3", "." * 80 + "é" * 80]
    few = WordEncoder(default_tokenizer(), max_words=8)
    for text in texts * 2:
        ids = whole.encode(text, add_special_tokens=False).ids
        assert enc.encode(text).tolist() == ids and few.encode(text).tolist() == ids, text
    for k in range(50):
        few.encode(f"often {'abcdefghij'[k % 10]}{'klmno'[k // 10]}")
        assert len(few.pieces) + len(few.pieces.before) <= 8 and ("often" in few.pieces or "often" in few.pieces.before)
