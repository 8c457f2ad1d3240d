from loomtext.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def rows(spark, data):
    return spark.createDataFrame(data, TURNS)


def brute(data):
    convs = {}
    for c, t, r, x in sorted(data, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, d[1] or 0, d[2] is not None, d[2] or "", d[3] is not None, d[3] or "")):
        convs.setdefault(c, []).append((r, x))
    order = sorted(convs, key=lambda c: (c is not None, c or 0))
    out = {}
    for i, c in enumerate(order):
        mine = convs[c]
        if any(len(o) > len(mine) and o[: len(mine)] == mine for o in convs.values()) or any(convs[o] == mine for o in order[:i]):
            continue
        out[c] = mine
    return out


def test_against_brute_force(spark, clashing):
    base = [("system", "s"), ("user", "hi"), ("assistant", "yes"), ("user", "more"), ("assistant", "<|im_end|> x")]
    data = []
    for c, n in enumerate([5, 3, 1, 5, 4]):
        data += [(c, i, *t) for i, t in enumerate(base[:n])]
    data += [(10, 0, "user", "hi"), (11, 0, None, "hi"), (12, 0, "user", None), (13, 0, "user", ""), (13, 1, "user", ""), (None, 0, "user", "lost"), (None, None, "user", "x"), (14, 5, "a", "t"), (14, 5, "a", "t"), (15, 0, "user", "long " * 100_000)]
    got = {r.conv_id: r for r in chat.format_chats(clashing(rows(spark, data), "rendered")).collect()}
    want = brute(data)
    assert set(got) == set(want)
    for c, turns in want.items():
        text = "".join(f"<|im_start|>{r or 'user'}\n{(x or '').replace('<|im_end|>', '<im_end>')}<|im_end|>\n" for r, x in turns)
        assert got[c].rendered == text and got[c].n_turns == len(turns)
    assert chat.format_chats(rows(spark, [])).collect() == []
