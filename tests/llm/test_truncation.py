"""Cut texts among whole ones: accuracy on planted cuts, and cases without a result."""

import random

from loomcat.llm import truncation


def _texts(n, limit, seed):
    rng = random.Random(seed)
    makers = ["Porranwen", "Reldorzan", "Palcorsor", "Halmardal", "Lorkelbren"]
    things = ["Slotted Blind Rivet", "Polished Wedge Anchor", "Condensing Unit", "Safety Glasses", "Flap Disc Coated", "Water Heater Tall"]
    ends = ["Pkg", "New Assy", "EA", "10/pk", ""]
    rows, cut = [], set()
    for i in range(n):
        size = " x ".join(f"{rng.randint(1, 999)} {rng.choice(['in', 'cm', 'lb'])}" for _ in range(rng.randint(1, 3)))
        tail = rng.sample(["with printed guide", "for indoor service", "tested before shipment"], rng.choice([0, 0, 1, 2]))
        t = " ".join(x for x in (rng.choice(makers), rng.choice(things), size, *tail, rng.choice(ends)) if x)
        feed = "tight" if i % 2 else "wide"
        if feed == "tight" and len(t) > limit:
            t = t[:limit]
            cut.add(i)
        elif rng.random() < 0.02:
            t = t[: rng.randint(len(t) // 2, len(t) - 3)].rstrip() + rng.choice(["...", "…", "�", "&am"])
            cut.add(i)
        rows.append((i, t, feed, "x"))
    return rows, cut


def test_planted(spark):
    rows, cut = _texts(4000, 52, 1)
    rows += [(5000, None, "tight", "x"), (5001, "", "wide", "x"), (5002, "   ", "wide", "x"), (5003, "A" * 30_000, "wide", "x"), (5004, "Whole thing Pkg", None, "x"), rows[1]]
    got = {r["row_id"] for r in truncation.cut_records(spark.createDataFrame(rows, "row_id long, description string, feed string, length string")).collect()}
    hit = len(got & cut)
    assert hit / len(got) > 0.85 and hit / len(cut) > 0.8 and not got & {5000, 5001, 5002, 5004}


def test_shares_and_empty(spark):
    rows, _ = _texts(400, 52, 2)
    df = spark.createDataFrame(rows, "row_id long, description string, feed string, x string")
    got = {r["feed"]: r for r in truncation.cut_shares(df).collect()}
    assert got["tight"]["share"] > got["wide"]["share"] and got["wide"]["records"] == 200
    assert truncation.cut_records(df.limit(0)).count() == 0 and truncation.cut_shares(df.limit(0)).count() == 0


def test_limits_in_bytes_blanks_and_padding(spark):
    rng, rows, cut = random.Random(5), [], set()
    words = ["Façade", "Décor", "Panel", "Bracket", "Lag", "Screw", "Señal", "Copper", "Hinge", "Valve"]
    for i in range(6000):
        t = " ".join(rng.choices(words, k=rng.randint(3, 9))) + rng.choice([" Pkg", " EA", " 10/pk"])
        feed = ("bytes", "padded", "free")[i % 3]
        if feed == "bytes" and len(t.encode()) > 44:
            t = t.encode()[:44].decode(errors="ignore")
            cut.add(i)
        if feed == "padded":
            cut |= {i} if len(t) > 40 else set()
            t = t[:40].ljust(40) if i % 2 else t[:40]
        rows.append((i, t, feed))
    got = {r["row_id"] for r in truncation.cut_records(spark.createDataFrame(rows, "row_id long, description string, feed string")).collect()}
    hit = len(got & cut)
    assert hit / len(got) > 0.93 and hit / len(cut) > 0.9
