import random

from quiver.llm.leakage import Items, Settings, find_passages, normal, unbeaten

ITEM = "The binding tenancy at Holcor was never renewed before 12 March 2009, and the panel held that upper well-known quota of 7,696 crowns remains separate where survey is void or frozen by law"
WORDS = ITEM.split()


def hits(text, items=((1, ITEM),), **kw):
    return [p[0] for p in Items(list(items), Settings(**kw)).passages(text)]


def fill(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("bcdfglmnr") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))


def test_what_makes_no_difference():
    body = f"{fill(40, 1)} {ITEM} {fill(40, 2)}"
    assert hits(body) == [1]
    assert hits(body.upper().replace(",", " ;")) == [1]
    assert hits(body.replace("tenancy", "ten-\nancy").replace(" of ", "\r\nof ")) == [1]
    assert hits(body.replace("well-known", "well-\nknown").replace("panel", "pa­nel")) == [1]
    header = "\n\nLand Tribunal of Corstow, 18 U 4/11 · Page 2 of 3\n\n"
    assert hits(body.replace(" held that ", f" held that{header}")) == [1]
    assert normal("STRASSE") == normal("strasse") and normal("ﬁne") == "fine" and normal("é") == "é"


def test_parts_and_errors():
    part = WORDS[3:27]
    for gone in (0, 12, 23):
        kept = part[:gone] + ["█████"] + part[gone + 1 :]
        assert hits(f"{fill(30, 3)} {' '.join(kept)} {fill(30, 4)}") == [1]
    swapped = ["xyzzy" if i in (5, 15) else w for i, w in enumerate(part)]
    assert hits(f"{fill(30, 3)} {' '.join(swapped)} {fill(30, 4)}") == [1]
    many = ["xyzzy" if i % 5 == 2 else w for i, w in enumerate(part)]
    assert hits(f"{fill(30, 3)} {' '.join(many)} {fill(30, 4)}") == []
    assert hits(f"{fill(30, 3)} {' '.join(WORDS[4:16])} {fill(30, 4)}") == []
    assert hits(" ".join(sorted(WORDS))) == []
    assert hits(f"{' '.join(WORDS[:11])} {fill(40, 5)} {' '.join(WORDS[11:22])}") == []


def test_spam_takes_time_in_proportion():
    import time

    took = []
    for n in (1500, 6000):
        text = f" {fill(3, 9)} ".join([" ".join(WORDS[2:14])] * n)
        began = time.process_time()
        assert hits(text) == []
        took.append(time.process_time() - began)
    assert took[1] < 12 * max(took[0], 0.05)
    assert hits(f"{text} {ITEM}") == [1]


def test_offsets_and_frames(spark):
    body = f"§ é🙂 {fill(20, 6)} {ITEM} {fill(10, 7)}"
    rows = [(1, body, 0), (2, None, 0), (3, "", 0), (4, f"{ITEM} {fill(60000, 8)} {ITEM}", 0), (5, ITEM, 1), (5, ITEM, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, ITEM, "en"), (7, ITEM, "en"), (8, "too short", "en"), (9, None, "en"), (10, "", "en")], "item_id long, text string, lang string")
    out = find_passages(docs, items).collect()
    assert sorted({(r.doc_id, r.item_id) for r in out}) == [(1, 7), (4, 7), (5, 7)]
    one = next(r for r in out if r.doc_id == 1)
    assert body[one.from_char : one.to_char] == ITEM and one.words >= 30
    split = find_passages(docs, items, Settings(block=1)).collect()
    assert {(r.doc_id, r.item_id) for r in split} == {(r.doc_id, r.item_id) for r in out}
    assert find_passages(docs.limit(0), items).count() == 0 and find_passages(docs, items.limit(0)).count() == 0


def test_short_run_between_a_header_and_an_error():
    header = "\n\nLand Tribunal of Corstow, 18 U 4/11 · Page 2 of 3\n\n"
    for short in (1, 2):
        at = 12 + short
        text = f"{' '.join(WORDS[:12])}{header}{' '.join(WORDS[12:at])} xyzzy {' '.join(WORDS[at + 1 : at + 13])}"
        assert hits(f"{fill(30, 3)} {text} {fill(30, 4)}") == [1]
    apart = f"{' '.join(WORDS[:12])}{header}{' '.join(WORDS[12:14])} {fill(30, 5)} {' '.join(WORDS[15:20])}"
    assert hits(f"{fill(30, 3)} {apart} {fill(30, 4)}") == []
    loose = " ".join(f"{fill(2, 60 + i)}\n{fill(1, 80 + i)}\n{w}" for i, w in enumerate(WORDS[12:24]))
    assert hits(f"{fill(30, 3)} {' '.join(WORDS[:12])} {loose} {fill(30, 4)}") == []


def test_any_hyphen_and_blank_at_a_line_end():
    for end in ("\u00ad\n", "\u00ad \r\n", "-\u00a0\n", "\u2010\u2003\n  ", "-\x0b\n"):
        text = ITEM
        for word in ("tenancy", "renewed", "before", "quota", "separate", "survey"):
            text = text.replace(word, f"{word[:3]}{end}{word[3:]}")
        assert hits(f"{fill(40, 1)} {text} {fill(40, 2)}") == [1], repr(end)
    assert hits(f"{fill(40, 1)} {ITEM} {fill(40, 2)}".replace(" ", "\u00a0")) == [1]


def test_only_beaten_chains_go():
    short = [(a, 5, 0, a) for a in range(100)]
    assert unbeaten([*short, (7, 12, 1, 7), (8, 12, 2, 8), (9, 10, 2, 9)]) == [short[0], (7, 12, 1, 7), (8, 12, 2, 8)]
    # an item and a text of few words, with more than 64 ways through them
    item = " ".join(["ab cd ef gh"] * 8 + ["ij kl mn op"])
    text = " ".join(["ab cd ef gh"] * 3 + ["xy"] + ["cd ef gh"] + ["ab cd ef gh"] * 20 + ["ij kl mn op"])
    assert hits(text, ((1, item),)) == [1]


def test_scripts_without_blanks():
    rng = random.Random(12)
    item = "本院認為原告之訴無理由應予駁回訴訟費用由原告負擔並告知兩造當事人得於二十日內上訴"
    han = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(4000))
    thai = "ศาลพิพากษายกฟ้องโจทก์และให้โจทก์ใช้ค่าฤชาธรรมเนียมแทนจำเลย"
    both = ((1, item), (2, thai))
    assert hits(han[:900] + item + han[900:], both) == [1]
    assert hits(f"{han[:300]}\n{item[:15]}\n{item[15:]}，{thai}。", both) == [1, 2]
    assert hits(han[:500] + item[:12] + han[500:], both) == []
    assert hits(f"{fill(30, 1)} {ITEM} {han[:50]} {fill(30, 2)}") == [1]


def test_a_template_that_many_items_share():
    import time

    head = "according to the settled case law of the court"
    items = [(i, f"{head} {fill(25, 1000 + i)}") for i in range(3000)]
    found = Items(items, Settings())
    text = " ".join(f"{head} {fill(30, 5000 + i)}" for i in range(50)) + f" {items[77][1]} "
    began = time.process_time()
    assert [p[0] for p in found.passages(text)] == [77]
    assert time.process_time() - began < 20
    longer = "according to the settled case law of the court the following question is to be decided now"
    found = Items([(i, f"{longer} {fill(25, 1000 + i)}") for i in range(300)], Settings())
    assert [p[0] for p in found.passages(f"{fill(20, 3)} {longer} {fill(20, 4)} {longer} {fill(25, 1042)}")] == [42]
