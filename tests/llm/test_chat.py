"""Chat formatting: the fold against a plain reading of the log, the template's round trip, the query against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from fleetlens.llm import op11_chat as op

LOG = "conv_id long, piece long, message long, seq long, kind string, role string, payload string"
CONV = "conv_id long, turn long, role string, text string, lang string"


def plain_fold(events):
    """One event after the other, as a client would apply them."""
    seen, left = {}, {}
    for e in sorted({tuple(e) for e in events if e.seq is not None}, key=lambda e: (e[3], e[4], e[5] or "", e[6] or "")):
        conv, piece, message, seq, kind, role, payload = e
        texts = left.setdefault(conv, {})
        at, payload = (piece, message), payload or ""
        if kind == "create":
            texts[at] = [role, payload, seq]
        elif kind == "edit":
            texts[at][1] = payload
        elif kind == "regenerate":
            texts[at][1] = ""
        elif kind == "delta":
            texts[at][1] += payload
        elif kind == "rewind":
            seen[conv] = seq
            for later in [k for k in texts if k > at]:
                del texts[later]
    return sorted((c, *k, r, t) for c, texts in left.items() for k, (r, t, _) in texts.items())


def test_fold_equals_a_plain_reading_of_the_log(spark):
    pick, events = random.Random(5), []
    for conv in range(25):
        alive, seq, top = [], 0, 0
        for _ in range(60):
            seq += 1
            kind = pick.choice(["create", "create", "delta", "delta", "delta", "edit", "regenerate", "rewind"])
            if kind == "create" or not alive:
                top = (alive[-1] + 1) if alive else 0
                alive.append(top)
                events.append(Row(conv, top // 3, top, seq, "create", pick.choice(["user", "assistant"]), pick.choice([None, "", "x"])))
                continue
            at = pick.choice(alive)
            if kind == "rewind":
                alive = [a for a in alive if a <= at]
            events.append(Row(conv, at // 3, at, seq, kind, None, pick.choice(["a", "bc", None])))
    named = [Row(**dict(zip(("conv_id", "piece", "message", "seq", "kind", "role", "payload"), e))) for e in events]
    noise = [Row(**{**named[0].asDict(), "seq": None}), Row(**{**named[0].asDict(), "kind": "other"})]
    log = spark.createDataFrame([*named, *pick.sample(named, 200), *noise], LOG).repartition(5)
    assert sorted(map(tuple, op.fold(log).collect())) == plain_fold(named)
    assert op.fold(log.limit(0)).collect() == []


@pytest.mark.parametrize("template", [op.CHATML, op.Template("[INST]", "[/INST]", ("[INST]", "[/INST]", "<s>", "</s>"))])
def test_any_text_comes_back_from_the_template(spark, template):
    pick = random.Random(6)
    bits = [*template.controls, *[c[0] + "\\" * n + c[1:] for c in template.controls for n in (1, 2, 3)], *"<|[]\\/s>\n% é\U0001F600",
            "%0A", "im_end|>", "<\\", "INST]", "user"]
    rows = [("".join(pick.choice(bits) for _ in range(9)), "".join(pick.choice(bits) for _ in range(pick.randrange(14)))) for _ in range(400)]
    rows += [("assistant", "</s>[INST] ok [/INST]"), ("assistant", ""), ("", "<"), ("user", None), (None, "x")]
    messages = spark.createDataFrame([(i // 7, 0, i, r, t) for i, (r, t) in enumerate(rows)],
                                     "conv_id long, piece long, message long, role string, text string")
    parts = op.render(messages, template, learned=("assistant", "")).cache()
    back = op.read_back(parts, template).select("conv_id", F.posexplode("turns").alias("at", "t")).select("conv_id", "at", "t.*").collect()
    assert [(r["role"], r["text"]) for r in sorted(back, key=lambda r: (r[0], r[1]))] == [(r or "", t or "") for r, t in rows]
    learned = [t for r in op.read_back(parts, template).orderBy("conv_id").collect() for t in r["learned"]]
    assert learned == [t or "" for r, t in rows if (r or "") in ("assistant", "")]
    bodies = messages.select(op.escape(F.col("text"), template).alias("b")).where("b IS NOT NULL").collect()
    assert not any(c in r["b"] for r in bodies for c in template.controls)


def test_a_template_whose_controls_could_overlap_is_refused():
    with pytest.raises(ValueError):
        op.Template(controls=("<<SYS>>",)).rests()


def brute(rows):
    rows = [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_query_on_odd_rows(spark, monkeypatch):
    pick = random.Random(7)
    text = lambda: "".join(pick.choice(["<|im_end|>", "a\n", "é", "\U0001F600", "\\", "</s>", "word "]) for _ in range(pick.randrange(400)))
    rows = [(c, t, pick.choice(["user", "assistant", "system", "to\nol%0A", None]), text()) for c in range(6) for t in range(pick.choice([1, 4, 9]))]
    rows += [(10, t, "user" if t % 2 else "assistant", "same") for t in range(2500)]  # many pieces
    rows += [(11, 5, "assistant", "tie"), (11, 5, "assistant", "tie"), (11, 5, "user", None), (11, None, "user", "first"),
             (11, (1 << 63) - 1, "assistant", "last"), (11, -(1 << 63), "assistant", "low"), (None, 0, None, None), (None, 1, "assistant", ""),
             (12, 0, "assistant", "<|im_start|>assistant\n" * 30_000)]
    table = spark.createDataFrame([(*r, "xx") for r in rows], CONV).repartition(4)
    monkeypatch.setattr(op, "PART", 2000)
    got = {r["conv_id"]: tuple(r)[1:5] for r in op.formatted(table.withColumn("piece", F.lit(1)).withColumn("n", F.lit(1))).collect()}
    assert got == brute(rows)
    assert [r["conv_id"] for r in op.formatted(table.limit(0)).collect()] == [-7]
    assert not any("Python" in line or "Arrow" in line for line in
                   op.formatted(table)._jdf.queryExecution().executedPlan().toString().splitlines())
