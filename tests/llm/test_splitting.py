import random

import numpy as np
import pyarrow as pa
import pytest

from rambleweave.llm import bpe as B
from rambleweave.llm.splitting import LEVELS, split_batch, split_oversized

WORDS = ["alpha", "beta,", "gamma.", "delta!\n", "\n\n", "```py\nx = 1\n\ny = 2\n```\n", "日本。語", "x" * 90, "   ", "(see)", "\t", "'s", "🎉"]


def make(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def brute(bpe, text, limit, overlap):
    """The same cuts by walking from piece to piece over the boundaries of one text."""
    from rambleweave.llm.splitting import boundaries

    data, edges = B.text_bytes(pa.array([text]))
    _, point, tokens, level = boundaries(bpe, data, edges)
    n = len(tokens) - 1
    out, i = [], 0
    while True:
        if tokens[n] - tokens[i] <= limit:
            return [*out, (point[i], point[n])]
        far = max(j for j in range(i, n + 1) if tokens[j] - tokens[i] <= limit)
        if far == i:
            far = i + 1
        inside = [j for j in range(i + 1, far + 1) if tokens[j] - tokens[i] >= (limit + 1) // 2]
        best = min((level[j] for j in inside), default=None)
        to = far if best is None else max(j for j in inside if level[j] <= best)
        out.append((point[i], point[to]))
        back = [j for j in range(i + 1, to) if tokens[to] - tokens[j] <= overlap]
        nxt = to
        for most in (3, 4, 5):
            fine = [j for j in back if level[j] <= most]
            if fine:
                nxt = fine[0]
                break
        i = nxt


@pytest.mark.parametrize("limit,overlap", [(512, 64), (40, 8), (20, 0)])
def test_pieces(limit, overlap):
    bpe = B.vocabulary()
    texts = [make(s, 40 + 100 * s) for s in range(6)] + [None, "", "short", "a" * 4000, "é" * 900, " " * 3000 + "end", "\n" * 2000, "word " * 2000]
    got = split_batch(bpe, pa.array(texts), limit, overlap)
    counts = bpe.count(pa.array(texts))
    assert set(got["row"].tolist()) == set(np.flatnonzero(counts > limit).tolist())
    for k in sorted(set(got["row"].tolist())):
        m = got["row"] == k
        text, begin, end = texts[k], got["begin"][m], got["end"][m]
        assert list(zip(begin, end)) == brute(bpe, text, limit, overlap)
        assert begin[0] == 0 and end[-1] == len(text) and (begin[1:] <= end[:-1]).all() and (begin[1:] > begin[:-1]).all()
        assert got["piece"][m].tolist() == list(range(m.sum())) and (got["tokens"][m] <= limit).all() and (got["shared"][m] <= overlap).all() and got["level"][m][-1] == 0
        own = bpe.count(pa.array([text[b:e] for b, e in zip(begin, end)]))
        assert (own <= got["tokens"][m]).all()


def test_natural_boundaries():
    bpe = B.vocabulary()
    para = "One sentence here. " * 10
    got = split_batch(bpe, pa.array([(para.strip() + "\n\n") * 6]), 60, 10)
    assert {LEVELS[x] for x in got["level"][:-1]} == {"paragraph"}
    code = "intro words " * 25 + "\n```\n" + "code line\n\n" * 8 + "```\nafter " * 1 + "more words " * 30
    got = split_batch(bpe, pa.array([code]), 80, 0)
    cut = [code[e:][:4] for e in got["end"][:-1]]
    assert cut[0] == "```\n"


def test_text_longer_than_a_chunk(monkeypatch):
    bpe = B.vocabulary()
    monkeypatch.setattr(B, "CHUNK_BYTES", 500)
    text = make(9, 1500) + "\n```\ncode here\n\n" + "more code\n\n" * 300 + "```\n\n" + make(10, 300)
    got = split_batch(bpe, pa.array(["x", text, "y"]), 40, 8)
    monkeypatch.undo()
    # chunks leave no trace: the same cuts, ends and overlaps as without them
    whole = split_batch(bpe, pa.array(["x", text, "y"]), 40, 8)
    assert all(got[k].tolist() == whole[k].tolist() for k in whole) and len(got["row"]) > 50
    for b, e, f, t in zip(got["begin"], got["end"], got["from"], got["to"]):
        assert text[b:e].encode() == got["data"][f:t].tobytes()


def test_text_of_five_megabytes():
    bpe = B.vocabulary()
    text = ". ".join(make(k, 60) for k in range(20)) * 700
    assert len(text.encode()) > 5_000_000
    got = split_batch(bpe, pa.array([text]), 512, 64)
    assert got["begin"][0] == 0 and got["end"][-1] == len(text) and (got["begin"][1:] <= got["end"][:-1]).all() and got["tokens"].max() <= 512
    assert (got["level"][:-1] > 0).all() and (got["shared"][1:] > 0).mean() > 0.9


def test_operator(spark):
    text = make(3, 900)
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (None, text, "x"), (1, text, "x")], "doc_id long, text string, piece string")
    rows = split_oversized(df).collect()
    assert {r.doc_id for r in rows} == {1, None}
    one = [r for r in rows if r.doc_id is None]
    assert [r.text for r in sorted(one, key=lambda r: r.piece)] == [text[r.begin : r.end] for r in sorted(one, key=lambda r: r.piece)]
    assert len([r for r in rows if r.doc_id == 1]) == 2 * len(one)
    assert split_oversized(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="overlap"):
        split_oversized(df, 10, 5)
