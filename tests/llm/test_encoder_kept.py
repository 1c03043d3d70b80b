"""What the encoder keeps between lots of texts, and how texts are dealt into lots."""

from collections import Counter

from tokenizers import Tokenizer

from bitloom.llm import token_files


def test_words_in_use_are_encoded_once():
    path, _ = token_files.default_tokenizer()
    library, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    encoder.most = 300
    seen, word_ids = Counter(), encoder._word_ids
    encoder._word_ids = lambda words, before=" ": (seen.update(words), word_ids(words, before))[1]
    letters = "abcdefghij"
    common = [f"common{a}{b}" for a in letters[:5] for b in letters[:4]]
    for lot in range(30):
        rare = [f"rare{letters[lot // 10]}{letters[lot % 10]}{a}{b}" for a in letters for b in letters[:8]]
        texts = ["- " + " ".join([*common, *rare[:40]]) + ".", "- " + " ".join([*rare[40:], *common]) + "\n- end"]
        assert [ids.tolist() for ids in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(seen) > 2000 and {seen[w] for w in common} == {1}
    assert sum(map(len, encoder.known.values())) <= encoder.most


def test_lots_hold_every_text_once():
    for texts in ([], [None], ["abc"] * 7, ["a" * 50, None, "", "b", "c" * 9, "d"], ["", None, ""]):
        runs = list(token_files.lots(texts, 10))
        assert [n for at, end in runs for n in range(at, end)] == list(range(len(texts)))
        assert all(sum(len(t or "") for t in texts[at : end - 1]) < 10 for at, end in runs)
