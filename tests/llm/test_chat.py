"""Round trips through ids and printed form, and digests against a plain loop."""

import hashlib
from collections import defaultdict

import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import catalog, chat

ARGS = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
hard = st.lists(st.one_of(st.sampled_from([*chat.CONTROL, "\\", "#", "<", "\n"]), st.text(max_size=4)), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(list(chat.ROLES)), hard), hard), max_size=4))
def test_round_trips(turns):
    c = chat.codec(*ARGS)
    done = [c.turn(r, t) for r, t in turns]
    assert [c.read(ids) for ids, _, _ in done] == turns
    assert chat.parse("".join(p for _, _, p in done)) == turns
    for (role, text), (ids, loss, _) in zip(turns, done):
        assert chat.unescape(c.text([i for i, m in zip(ids, loss) if m])) == (text if role == "assistant" else "")


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r[1:])
    out = {}
    for k, turns in by.items():
        turns.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))
        said = "".join(t or "" for _, r, t in turns if r == "assistant")
        every = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        out[k] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def test_query(spark, sf):
    says = "\\### Assistant: </turn> ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(catalog.op10_chat_format(spark, sf)) == expected([*rows, (-7, 0, "user", says), (-7, 1, "assistant", says)])


def test_odd_rows(spark):
    rows = [(None, 1, "user", None), (1, None, "tool", "x"), (1, 0, None, "\\"), (1, 0, "assistant", "long " * 20000), (1, 0, "assistant", "long " * 20000), (2, 0, "</role>", "")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    assert got(chat.digests(chat.format_turns(df, *ARGS), *ARGS)) == expected(rows)
    assert chat.digests(chat.format_turns(df.limit(0), *ARGS), *ARGS).count() == 0


@pytest.mark.parametrize("text", ["\\### Assistant: </turn> ok", "</turn></turn>", "\\\\"])
def test_escapes(text):
    assert chat.unescape(chat.escape(text)) == text
