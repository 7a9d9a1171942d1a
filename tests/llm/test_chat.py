"""Chat formatting, read back and compared with the conversations."""

import hashlib
import random

import pytest

from updraft.llm import chat

SF = "/root/testdata/sf0.001"
DDL = "conv_id long, turn long, role string, text string"


def digests(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = set()
    for conv, own in by.items():
        own = sorted(own, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r[1:]))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learnt = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out.add((conv, len(own), hashlib.sha256(said.encode()).hexdigest(), len(learnt),
                 hashlib.sha256(learnt.encode()).hexdigest()))
    return out


def test_op10_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    tricky = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)]
    assert {tuple(r)[:5] for r in chat.op10_prefix_rendering(spark, SF).collect()} == digests(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_odd_rows_read_back(spark, seed):
    rng = random.Random(seed)
    parts = ["\\", "[", "]", "<", "</s>", "[INST]", " ", "[/INST]", "a", "b", "\n", "é", "😀", "[ROLE x] ", "<s>"]

    def text():
        return rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))])

    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(30)]),
             rng.choice(["user", "assistant", "system", "tool", None, "a] b", "[x"]), text()) for _ in range(300)]
    rows += [rows[0], (4, 0, "assistant", "long " * 50_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], DDL + ", piece int")
    assert {tuple(r)[:5] for r in chat.read_back(chat.format_turns(df)).collect()} == digests(rows)
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


def test_rewriting_template_is_detected(spark):
    def drops_thoughts(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 or r != 'assistant' else t.split('|')[-1]}"
                       for i, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "think|yes"), (1, 2, "user", "so")]
    out = chat.format_turns(spark.createDataFrame(rows, DDL), drops_thoughts).collect()
    assert [r.rewrites for r in out] == [False, False, True]
    text = ""
    for r in out:
        text = text[:len(text) - r.taken_back] + r.piece
    assert text == drops_thoughts([(r[2], r[3]) for r in rows])
    assert [(r.loss_start, r.loss_end) for r in out] == [(None, None)] * 3      # its text began where the rewriting did


def masked(render, rows):
    """Slow form of the mask: which turn wrote each character, dropped as soon as a prefix of it changes."""
    text, owner, spans = "", [], {}
    for k, (role, said) in enumerate(rows):
        after = render(rows[:k + 1])
        same = 0
        while same < min(len(text), len(after)) and text[same] == after[same]:
            same += 1
        shown = [render([*rows[:k], (role, p)]) for p in chat.PROBES]
        head = 0
        while head < min(map(len, shown)) and shown[0][head] == shown[1][head]:
            head += 1
        tail = 0
        while tail < min(map(len, shown)) - head and shown[0][-1 - tail] == shown[1][-1 - tail]:
            tail += 1
        learnt = range(max(head, same), len(after) - tail) if role == "assistant" else ()
        owner = owner[:same] + [k if at in learnt else None for at in range(same, len(after))]
        text = after
    for at, k in enumerate(owner):
        if k is not None:
            spans.setdefault(k, []).append(at)
    return {k: (v[0], v[-1] + 1) for k, v in spans.items()}


@pytest.mark.parametrize("seed", range(3))
def test_rewritten_text_leaves_the_mask(spark, seed):
    """Templates that shorten earlier answers in ways of their own, against a character by character mask."""
    rng = random.Random(seed)
    keep = rng.randint(1, 3)

    def render(turns):
        out = []
        for i, (r, t) in enumerate(turns):
            old = len(turns) - 1 - i
            out.append(f"<{r}>{t[:4] if r == 'assistant' and old >= keep and len(t) > 6 else t};")
        return "".join(out)

    said = [[(rng.choice(["user", "assistant"]), "".join(rng.choice("xyz") for _ in range(rng.randint(1, 12))))
             for _ in range(14)] for _ in range(4)]
    rows = [(c, k, *turn) for c, turns in enumerate(said) for k, turn in enumerate(turns)]
    found = {}
    for r in chat.format_turns(spark.createDataFrame(rows, DDL), render).collect():
        if r.loss_start is not None and r.loss_end > r.loss_start:
            found.setdefault(r.conv_id, {})[r.turn] = (r.loss_start, r.loss_end)
    assert {c: f for c, f in found.items() if f} == {c: m for c, t in enumerate(said) if (m := masked(render, t))}
    assert any(len(f) < sum(r == "assistant" for r, _ in t) or any(
        e - s == 4 for s, e in f.values()) for f, t in zip(found.values(), said))


def test_a_rewriting_template_fails_with_a_window():
    def render(turns):
        return "".join(f"<{len(turns)}>{t}" for _, t in turns)

    state = chat._Renderer(render, ("assistant",), 2)
    with pytest.raises(ValueError):
        for k in range(6):
            state.add(1, k, "assistant", f"turn {k}")


def test_prefixes_of_short_conversations_are_exact():
    turns = [("system", "s"), *[("user" if i % 2 else "assistant", f"t{i}[") for i in range(7)]]
    state = chat._Renderer(chat.bracket_template, ("assistant",), chat.WINDOW)
    text = ""
    for k, (role, said) in enumerate(turns):
        _, _, _, piece, back, start, a, b, _ = state.add(1, k, role, said)[-1]
        text = text[:len(text) - back] + piece
        assert text == chat.bracket_template(turns[:k + 1])
        assert (a is None) == (role != "assistant")
        if a is not None:
            assert chat.unescape(text[a:b]) == said


def test_templates_that_look_far_back_are_exact(spark):
    """Turn numbers, system text moved into the first user turn, and thoughts dropped from all earlier answers."""
    def render(turns):
        system = "".join(t for r, t in turns if r == "system")
        out = []
        for i, (r, t) in enumerate(turns):
            if r == "assistant" and any(x == "user" for x, _ in turns[i + 1:]) and len(turns) > 12:
                t = t.split("|")[-1]
            out.append("" if r == "system" else f"<{i} {r}>{system if i == 1 else ''}{t}")
        return "".join(out)

    rows = [(1, 0, "system", "be kind")] + [(1, k, "user" if k % 2 else "assistant", f"think {k}|say {k}") for k in range(1, 21)]
    out = chat.format_turns(spark.createDataFrame(rows, DDL), render).collect()
    text = ""
    for k, r in enumerate(out):
        text = text[:len(text) - r.taken_back] + r.piece
        assert text == render([(x[2], x[3]) for x in rows[:k + 1]])
        assert r.start + len(r.piece) == len(text)
    assert max(r.taken_back for r in out) > 100        # a rewrite far back is seen


def test_op10_renders_whole_prefixes(spark, tmp_path, monkeypatch):
    """The query hands its turns to the operator without a window, long conversations too."""
    rows = [(c, k, "assistant" if k % 2 else "user", f"turn {k} [of] {c}") for c in (1, 2) for k in range(40)]
    spark.createDataFrame(rows, DDL).write.parquet(str(tmp_path / "conversations.parquet"))
    asked, real = [], chat.format_turns
    monkeypatch.setattr(chat, "format_turns", lambda *a, **k: asked.append((a[1:], k)) or real(*a, **k))
    got = {tuple(r)[:5] for r in chat.op10_prefix_rendering(spark, str(tmp_path)).collect()}
    assert asked == [((), {})]
    tricky = "</s>[INST] ok [/INST]"
    assert got == digests([*rows, (-1, 0, "user", tricky), (-1, 1, "assistant", tricky)])
