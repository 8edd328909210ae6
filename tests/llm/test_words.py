"""Words of op2_best_fit_packing and the pipeline's packing: the same ids as the tokenizer's own, most of them without it."""

from tokenizers import Tokenizer

from sievewell.llm import packing

LETTERS = [chr(c) for c in range(0xC0, 0x180) if chr(c).isalpha()] + list("abzAZµªºKÅẞſﬁΣİ")
MARKS = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]


def _tokenizer():
    plain = Tokenizer.from_file(packing.default_vocabulary())
    plain.encode_special_tokens = True
    return plain


def test_words_with_marks_behind_them_need_no_tokenizer():
    tok, asked = packing._WordTokenizer(packing.default_vocabulary()), []
    ask = tok._ask
    tok._ask = lambda words: (asked.extend(words), ask(words))[1]
    text = "HEAT!! ofto*** ch,%%% Straße. Straße ÀÉÿ;-) don't x9"
    assert tok.encode([text]) == [tok._raw(_tokenizer().encode(text, add_special_tokens=False).ids)]
    assert sorted(asked) == ["don't", "x9"]


def test_letters_and_marks_have_the_tokenizer_s_ids():
    words = [f"{a}{x}{b}" for a in LETTERS for x in ("", "s", "SS") for b in ("", ".", "'", "!?", "|>", "\t.", "́")]
    words += [f"Word{a}{b}" for a in MARKS for b in MARKS] + [f"{a}word{b}{a}" for a in MARKS for b in MARKS]
    got = packing._WordTokenizer(packing.default_vocabulary()).encode(words)
    tok = _tokenizer()
    assert [w for w, raw in zip(words, got) if raw != packing._WordTokenizer._raw(tok.encode(w, add_special_tokens=False).ids)] == []


def test_texts_stand_apart_however_they_are_cut(monkeypatch):
    import pyarrow as pa

    texts = ["one two", None, "", "two\none two", " ", "a" * 90, "Zwei, zwei! " * 30]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    runs = []
    for most in (1, 40, 4_000_000):
        monkeypatch.setattr(packing, "_TEXT_BYTES", most)
        runs.append([r for b in packing._pieces(packing.default_vocabulary(), 7, 0)([rows, rows.slice(2, 3)]) for r in b.to_pylist()])
    assert runs[0] == runs[1] == runs[2] and {r["doc_id"] for r in runs[0]} == set(range(len(texts)))
