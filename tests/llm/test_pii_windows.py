"""Personal data that reaches further than the window around its trigger."""

from __future__ import annotations

import random
import time
import tracemalloc

import pytest

from hindsail.llm import crf, pii


@pytest.fixture(scope="module")
def model(spark):
    return pii.train_tagger(pii.labelled_table(spark))


def test_windows_end_at_white_space():
    r = random.Random(3)
    for _ in range(300):
        text = "".join(r.choice("abcdefgh" * 8 + " @1.") for _ in range(r.randint(0, 600)))
        found = list(pii.windows(text))
        assert all(a < b for (_, a), (b, _) in zip(found, found[1:]))
        for lo, hi in found:
            assert (lo == 0 or text[lo - 1].isspace()) and (hi == len(text) or text[hi].isspace())
        for m in pii.TRIGGER.finditer(text):
            assert any(lo <= max(0, m.start() - pii.REACH) and min(len(text), m.end() + pii.REACH) <= hi for lo, hi in found)


def test_long_names_are_found_whole(spark, model):
    name = "abcdefghij" * 5
    for text in (f"write word12 @ {name}.example.net now", f"write ann [at] {name} [dot] com now"):
        end = text.index(" now")
        (span,) = pii.add_spans([text], [pii.base_spans(text)], model)[0]
        assert span[1:] == (end, "email")


def test_local_parts_of_sixty_letters(spark, model):
    """A window never begins inside a word, so nothing of an address is left in a masked text."""
    name = "abcdefghij" * 6
    for text in (f"write {name} [at] site [dot] com soon", f"write {name} (at) site.org soon"):
        (span,) = pii.add_spans([text], [pii.base_spans(text)], model)[0]
        assert span == (6, text.index(" soon"), "email")
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        assert pii.mask_pii(df, model).first().text == "write [EMAIL] soon"


def plain_labels(model, names):
    """Viterbi over one sequence, all of it in Python numbers."""
    best, back = None, []
    for ids in model.numbers(names):
        own = model.weights[ids].sum(axis=0)
        if best is None:
            best = model.starts + own
        else:
            paths = best[:, None] + model.moves
            back.append(paths.argmax(axis=0))
            best = paths.max(axis=0) + own
    labels = [int(best.argmax())]
    for step in reversed(back):
        labels.append(int(step[labels[-1]]))
    return labels[::-1]


def test_pieces_carry_the_scores(model, monkeypatch):
    """Sequences of very unlike lengths, decoded in small cells, as one by one."""
    r = random.Random(5)
    texts = [" ".join(r.choice(["call", "5551234", "(743)", "555-3824", "at", "x@y", "10.0.0.7", "order"]) for _ in range(n)) for n in (700, 1, 2, 90, 91, 300, 5, 5, 5)]
    tokens = [pii.tokens_of(t, 0, len(t)) for t in texts]
    want = [plain_labels(model, pii.features(k, t)) for k, t in zip(tokens, texts)]
    for cells, held in ((1 << 16, 1 << 13), (200, 50), (1, 1)):
        monkeypatch.setattr(crf, "CELLS", cells)
        monkeypatch.setattr(crf, "HELD", held)
        assert model.decode([len(k) for k in tokens], lambda i, lo, hi: pii.features(tokens[i], texts[i], lo, hi)) == want


def test_one_long_text_beside_many(model):
    """A text of 20,000 numbers beside 600 short ones: under 500 MB and a few seconds."""
    r = random.Random(9)
    long = " ".join(str(r.randrange(10**6)) for _ in range(20_000))
    texts = [long, *(f"call (743) 555-38{i % 90 + 10} or write" for i in range(600))]
    base = [pii.base_spans(t) for t in texts]
    tracemalloc.start()
    began = time.process_time()
    found = pii.add_spans(texts, base, model)
    took, (_, peak) = time.process_time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 200e6 and took < 30, (peak, took)  # with tracing, which is several times slower
    assert found[0] == pii.add_spans([long], base[:1], model)[0] and found[1] == pii.add_spans(texts[1:2], base[1:2], model)[0]
