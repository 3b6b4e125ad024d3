import hashlib

from tabloom.llm import chat

CONV = "conv_id long, turn long, role string, text string, tokens long, block long, system string"


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "s") for r in rows], CONV)


def brute(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {c: (len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(a := "".join(x for r, x in t if r == "assistant")), sha(a))
            for c, t in out.items()}


def test_escape_round_trip():
    for text in ("", "\\", "###", "####", "</turn>", "\\</turn>", "\\### Assistant: </turn> ok", "#" * 7 + "</turn></turn>\\\\", "a\n### user: b</turn>\n"):
        turn, begin, end = chat.format_turn("as:si\\st</turn>ant", text)
        assert chat.parse(turn) == [("as:si\\st</turn>ant", text)] and chat.unescape(turn[begin:end]) == text
    many = "".join(chat.format_turn(r, t)[0] for r, t in [("user", "### user: x</turn>\n"), ("assistant", "")])
    assert chat.parse(many) == [("user", "### user: x</turn>\n"), ("assistant", "")]


def _digests(windows):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.conversation_digests(windows).collect()}


def test_odd_rows(spark, bpe_file):
    tricky = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", None), (1, 2, "assistant", "é" * 40), (2, None, "user", "x"), (2, 0, "assistant", "y"),
            (None, 0, "user", "no id"), (None, 1, "assistant", "yes"), (3, 0, None, "nobody"), (4, 0, "user", "same"), (4, 0, "user", "same"),
            (4, 1, "assistant", "tie b"), (4, 1, "assistant", "tie a"), (-7, 0, "user", tricky), (-7, 1, "assistant", tricky),
            (5, 0, "user", "long " * 20_000), (5, 1, "assistant", "long " * 20_000), (5, 2, "user", "z"), (6, 3, "system", "")]
    for budget, history in ((1024, 256), (40, 0), (30, 14)):
        assert _digests(chat.format_conversations(_table(spark, rows), bpe_file, budget, history)) == brute(rows)
    assert chat.conversation_digests(chat.format_conversations(_table(spark, []), bpe_file)).count() == 0


def test_windows_keep_budget_system_and_history(spark, bpe_file):
    rows = [(1, 0, "system", "Answer in French.")] + [(1, t, "assistant" if t % 2 == 0 else "user", f"turn {t} " + "w " * (t % 9)) for t in range(1, 400)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(50)]
    budget, history = 120, 40
    windows = sorted(chat.format_conversations(_table(spark, rows), bpe_file, budget, history).collect(), key=lambda w: (w.conv_id, w.window))
    assert _digests(chat.format_conversations(_table(spark, rows), bpe_file, budget, history)) == brute(rows)
    assert all(w.tokens <= budget and not w.over_budget for w in windows)
    later = [w for w in windows if w.conv_id == 1][1:]
    assert later and all(chat.parse(w.text)[0] == ("system", "Answer in French.") for w in later)
    assert sum(w.context_turns > 1 for w in later) > len(later) / 2
    assert all(w.context_turns > 0 for w in [w for w in windows if w.conv_id == 2][1:])
    seen = [chat.parse(w.text)[w.context_turns:] for w in windows if w.conv_id == 1]
    assert [t for s in seen for t in s] == [(r[2], r[3]) for r in rows if r[0] == 1]


def test_hot_conversation_spans_blocks(spark, bpe_file):
    rows = [(7, t, "assistant" if t % 2 else "user", f"hot {t}") for t in range(3000)] + [(100 + i, 0, "user", "u") for i in range(300)]
    windows = chat.format_conversations(_table(spark, rows), bpe_file, 64, 16)
    assert _digests(windows) == brute(rows)


def test_damaged_windows_are_refused_at_once():
    import time

    import pytest

    from tabloom.llm.chat import format_turn, parse
    whole = format_turn("user", "a long enough text with many words in it " * 50)[0]
    began = time.perf_counter()
    for broken in (whole[:-3], whole[:200], whole.replace("</turn>", ""), "### role without end", whole + "x"):
        with pytest.raises(ValueError):
            parse(broken)
    assert time.perf_counter() - began < 1
