import base64
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm.wordpiece import Automaton, count_tokens
from tests.llm.conftest import AWKWARD


def greedy(word, known):
    n = at = 0
    while at < len(word):
        end = min(len(word), at + max(map(len, known)))
        while word[at:end] not in known and end > at + 1:
            end -= 1
        at, n = end, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=30), st.lists(st.sampled_from(b"ab\xc3c"), max_size=60))
def test_equals_greedy_matching(pieces, letters):
    pieces |= {b"ab", b"abab", b"bc", b"aabc", b"cab\xc3"}
    assert Automaton(pieces).count(bytes(letters)) == greedy(bytes(letters), pieces | {b"a"})


def test_texts(spark, docs, tmp_path):
    r = random.Random(2)
    pieces = {bytes(r.choice(b" wordheinsx") for _ in range(r.randint(1, 5))) for _ in range(300)}
    path = tmp_path / "v.tiktoken"
    path.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for i, p in enumerate(pieces)))
    rows = AWKWARD + [(50, "whoredsin" * 9000, "s")]
    got = count_tokens(docs(*rows), ["doc_id", "source"], path=str(path)).collect()
    want = sorted((len((t or "").encode().split()), sum(greedy(b" " + w, pieces) for w in (t or "").encode().split())) for _, t, _ in rows)
    assert sorted((x["n_words"], x["n_tokens"]) for x in got) == want
    assert count_tokens(docs(), ["doc_id"], path=str(path)).count() == 0


def test_other_libraries_word_piece(spark, docs):
    from tokenizers import models

    pieces = ["th", "the", "re", "r", "e", "##re", "##e", "##r", "##on", "##o", "##n", "##eron", "t", "##h"]
    model = models.WordPiece({p: i for i, p in enumerate([*pieces, "[UNK]"])}, unk_token="[UNK]")
    automaton = Automaton([(" " + p if p[:2] != "##" else p[2:]).encode() for p in pieces])
    for word in ("there", "theron", "thereon", "rere", "eronron", "theee", "re"):
        assert automaton.count(b" " + word.encode()) == len(model.tokenize(word)), word
