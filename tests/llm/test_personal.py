import pytest

from convoloom.llm import personal as p

PEOPLE = [(g + e, f + s) for g in ("Jor", "Fen", "Tov", "El", "Bri") for e in ("bet", "dan", "ina", "ko", "wyn", "ric") for f in ("Ash", "Dor", "Kest", "Pet", "Zel") for s in ("wick", "combe", "dal", "ovic", "rell", "vist")][::7]


@pytest.fixture(scope="module")
def names():
    return p.Gazetteer([*PEOPLE, (None, None), ("Vélia", "O'Ashdal")])


def found(text, names):
    return [(k, text[a:b]) for k, a, b, _, v in p.find_spans(text, names) if -1 not in v]


@pytest.mark.parametrize("text, item", [("to a.b+c@x.example now", "a.b+c@x.example"), ("<A_B@X.EXAMPLE.ORG>", "A_B@X.EXAMPLE.ORG"), ("user=a1 @ corp.example;role", "a1 @ corp.example"), ("a [at] x [dot] example", "a [at] x [dot] example"), ("a(at)x.example", "a(at)x.example"), ("?to=a%40x.example&l", "a%40x.example"), ("r@bücher.example", "r@bücher.example")])
def test_emails(names, text, item):
    assert found(text, names) == [("email", item)]


@pytest.mark.parametrize("text", ["git@forge.example:tools/a.git", "view-kit@4.17.1 pinned", "@types/node@20.1", "the decorator @cached(at) is gone", "no at all"])
def test_no_emails(names, text):
    assert [k for k, *_ in found(text, names) if k == "email"] == []


@pytest.mark.parametrize("item", ["+44 1632 960159", "01632 960 128", "+44 (0)7700 900128", "+49 (0)30/23125-108", "+49 30 23125 153", "01 99 00 13 39", "+33 1 99 00 13 30", "(479) 555-0122", "243-555-0156", "+1.667.555.0109", "+14575550175", "+1 565 555 0193"])
def test_phones(names, item):
    assert found(f"call {item} now", names) == [("phone", item)]


@pytest.mark.parametrize("item", ["948-96-2547", "948 96 2547", "QQ 44 59 55 B", "QQ117594B", "08 347 864 221", "79380512W", "K48873184"])
def test_ids(names, item):
    assert found(f"id={item}", names) == [("id_number", item)]


@pytest.mark.parametrize("text", ["Build 202451-5550187 passed", "Ticket QX-1573077", "row id is 1554815548", "Checksum is 947121535652", "Version 3.14.185.2", "Order no. 180-11-18011", "Order no. 23-11-2311", "10.0.120.7:8080", "Trace 9489a08a16ca18fd"])
def test_numbers_that_are_nobodys(names, text):
    assert found(text, names) == []


@pytest.mark.parametrize("item", ["Apt 18C, 157 Copperfield End Ave, Fennwick", "112 Larkmoor Rd., Grauwald", "55B Copperfield End Close, Port Essey 7200", "Kornweg 287, 69365 Ribanueva", "Mühlenstraße 180, 77637 Port Essey", "Rua do Moinho 253, Ribanueva", "Calle del Molino 17, Valombre", "206, rue de la Forge, Port Essey", "95 rue des Ormes, 50804 Fennwick"])
def test_addresses(names, item):
    assert found(f"moved to {item}", names) == [("address", item)]


@pytest.mark.parametrize("text", ["Chapter 71, Street View import.", "Block 115 Road Map view is empty.", "Main Street owns that folder."])
def test_no_addresses(names, text):
    assert found(text, names) == []


@pytest.mark.parametrize(
    "text, item",
    [("Hi, this is Jorbet Ashwick.", "Jorbet Ashwick"), ("Ask Ashwick, Jorbet about", "Ashwick, Jorbet"), ("Frau Fenko T. Dorcombe hat", "Fenko T. Dorcombe"), ("Y. Kestdal / x", "Y. Kestdal"), ("Dr. Tovric K. said", "Tovric K."), ("Elwyn van Petovic", "Elwyn van Petovic"), ("Elwyn K. van Petovic", "Elwyn K. van Petovic"), ("Briina Zeldal's branch", "Briina Zeldal"), ("name: jorbet ashwick", "jorbet ashwick"), ("JORBET ASHWICK-DORDAL", "JORBET ASHWICK-DORDAL"), ("Vélia O'Ashdal", "Vélia O'Ashdal"), ("Fendan Jorko Ashrell", "Fendan Jorko Ashrell")],
)
def test_names(names, text, item):
    assert found(text, names) == [("name", item)]


@pytest.mark.parametrize("text", ["Der Grund liegt darin", "the branch is open", "src/ashwick.py", "Jorbet Ashwick owns that folder", "jorbet"])
def test_no_names(names, text):
    assert found(text, names) == []


def test_short_and_very_long_names():
    short = p.Gazetteer([*PEOPLE, ("Ana", "Li"), ("Eva", "Ashdal")])
    assert found("Ask Ana Li about", short) == [("name", "Ana Li")] and found("Ask Eva Ashdal about", short) == [("name", "Eva Ashdal")]
    assert found("in ana li", short) == [] and found("Ask Max", short) == []
    long = "Zel" + "ash" * 300 + "wick"
    assert p.Gazetteer([("Abcdefghij" * 9, "Xy" * 80)]).look("Xy" * 80) == (0, 2) and short.look(long) == (0, 0)


def test_names_inside_emails_are_none(names):
    assert found("jorbet.ashwick@x.example", names) == [("email", "jorbet.ashwick@x.example")]


def test_labelers_that_say_no_win():
    counts = [("email", "plain", (1, 1, 1, 1), 500), ("email", "plain", (1, 0, 0, 1), 5), ("email", "plain", (-1, 0, -1, 1), 90), ("email", "plain", (1, 0, -1, -1), 80)]
    post = p.reliabilities(counts)
    verdict = p.train_classifier(counts, post)
    assert [verdict[k, f, v] for k, f, v, _ in counts] == [True, True, False, False]


def test_frames(spark):
    roster = spark.createDataFrame(PEOPLE, "given_name string, family_name string")
    text = "Ask Jorbet Ashwick (a.b@x.example) or call 01632 960 128."
    rows = [("m", 1, "f", text, 5), ("m", 2, "f", None, 5), ("m", 3, "f", "", 5), ("m", 4, "f", "nothing here", 5), ("m", 5, "f", "😀 " * 30000 + text, 5), ("m", 6, "f", text, 5), ("m", 6, "f", text, 5)]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, field string, text string, kind int")
    items = p.personal_items(df, roster)
    got = sorted(map(tuple, items.where("row_id in (1, 5)").collect()))
    assert [(r[1], r[3], r[4]) for r in got] == [(1, "email", 21), (1, "name", 5), (1, "phone", 44), (5, "email", 60021), (5, "name", 60005), (5, "phone", 60044)]
    assert items.where("row_id = 6").count() == 6
    red = {r["row_id"]: r["text"] for r in p.redact(df.select("tbl", "row_id", "field", "text").dropDuplicates(), items).collect()}
    assert red[1] == red[6] == "Ask [NAME] ([EMAIL]) or call [PHONE]." and red[2] is None and red[3] == "" and red[4] == "nothing here" and red[5].endswith("😀 Ask [NAME] ([EMAIL]) or call [PHONE].")
    assert p.personal_items(df.limit(0), roster).count() == 0
    assert {r["kind"] for r in p.personal_items(df, roster.limit(0)).collect()} == {"email", "phone"}


def test_archive(spark, sf):
    got = p.p2_found(spark, sf)
    assert got.dtypes == [("tbl", "string"), ("row_id", "bigint"), ("field", "string"), ("kind", "string"), ("start_pos", "int")] and {r[0] for r in got.select("kind").distinct().collect()} == set(p.KINDS)
