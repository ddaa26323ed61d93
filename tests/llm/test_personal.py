"""Personal information: kinds, disguises, look-alikes that are none, offsets."""

import pytest

from graphlens.llm.personal import Names, detect, find_personal, replace, replace_personal

GIVEN = "Ulwen Wileth Ololan Linoten Eliva Linwen Selya Daloten Garamir Garoten Daliva Selwen Oliva Alwen Linoric Garoric Daloric Uloric Perwen Garwen Dalwen Tamwen".split()
FAMILY = "Pellubrek Łakinekov Moruley Eldotwell Fairdelling Nettovane Fairgarthen Lundotwell Rookovikson Östardane Pellovane Fairovane Grimovane Eldovane Lundovane Morovane".split()
NAMES = Names(GIVEN, FAMILY)


def got(text):
    return {(k, text[a:b]) for a, b, k in detect(text, NAMES)}


@pytest.mark.parametrize("text, value", [
    ("Signed-off-by: Ulwen Pellubrek <x>", "Ulwen Pellubrek"), ("cc selya moruley", "selya moruley"), ("Author: ELIVA LAKINEKOV.", "ELIVA LAKINEKOV"),
    ("Dr. Fairdelling, Oliva signed", "Fairdelling, Oliva"), ("met Alwen G. Eldotwell today", "Alwen G. Eldotwell"), ("— Garoten van der Nettovane", "Garoten van der Nettovane"),
    ("by Linwen-Selya Moruley-Eldotwell, too", "Linwen-Selya Moruley-Eldotwell"), ("this is Daloric Grimovane from", "Daloric Grimovane"), ("Östardane Eliva", "Östardane Eliva")])
def test_names(text, value):
    assert got(text) == {("name", value)}


@pytest.mark.parametrize("text", ["Ask Selya whether", "The Eliva Scheduler", "selya_moruley", "tests under faster", "@selya moruley", "path/Selya Moruley/x", "Graph Store and Edge Writer"])
def test_no_names(text):
    assert not {x for x in got(text) if x[0] == "name"}


@pytest.mark.parametrize("text, kind, value", [
    ("mailto:a.b+c@mail.example.net.", "email", "a.b+c@mail.example.net"), ("(x-y [at] example [dot] org)", "email", "x-y [at] example [dot] org"),
    ("From: u5 at trace dot example", "email", "u5 at trace dot example"), ("<q(at)dev.token.invalid>", "email", "q(at)dev.token.invalid"), ("(A@B.EXAMPLE)", "email", "A@B.EXAMPLE"),
    ("Call me at +49 (0)30 23125667.", "phone", "+49 (0)30 23125667"), ("(030 23125-572)", "phone", "030 23125-572"), ("fax (415) 555-0177 x", "phone", "(415) 555-0177"),
    ("T 01.99.00.45.61", "phone", "01.99.00.45.61"), ("Phone 020 7946 0743, ext. 12", "phone", "020 7946 0743"), ("tel: 07700 900534", "phone", "07700 900534"),
    ("+33 1 99 00 29 59 | x", "phone", "+33 1 99 00 29 59"), ("call five five five zero one two three four five six now", None, None),
    ("SSN: 924-43-0156", "id_number", "924-43-0156"), ("NI number QQ 01 20 89 B", "id_number", "QQ 01 20 89 B"), ("tax id 12 320 653 658 x", "id_number", "12 320 653 658"),
    ("personal id 26633452235", "id_number", "26633452235"), ("ID card LX-211757-3", "id_number", "LX-211757-3"), ("passport Z8230299", "id_number", "Z8230299"),
    ("Office: 68 rue des Graphs", "address", "68 rue des Graphs"), ("57, rue de Wenmere.", "address", "57, rue de Wenmere"), ("Calle del Harton 132, x", "address", "Calle del Harton 132"),
    ("158 Old Silton St. The", "address", "158 Old Silton St"), ("Bramrowstr. 8a", "address", "Bramrowstr. 8a"), ("23b Ottwick Rd", "address", "23b Ottwick Rd"), ("Silmerestraße 51\n", "address", "Silmerestraße 51")])
def test_kinds(text, kind, value):
    assert got(text) == ({(kind, value)} if kind else set())


@pytest.mark.parametrize("text", [
    "git@forge.example:a/b.git", "postgres://reader@db.invalid:5432/x", "Pinned a@2.8.4 and @scope/b@7.1.0", "view@2x.png", "@app.route('/x')", "I look at the dot plot", "run 62424-470",
    "Node 192.0.2.17", "ISBN-like id 978-0-00-98946450 is", "Build 202504701 finished at 2025-04-13 10:22:31.", "size 12 345 678 bytes", "000000000038539000000000067010",
    "12 Main steps, then drive D: is full.", "Lane 648 of the", " * HOLDS 31547 CALLER ROWS, 398 OF", "", "   ", "commit 8f4f87c"])
def test_nothing(text):
    assert got(text) == set()


def test_offsets_survive_rewriting():
    text = "x\u200b mailto:se\u200blya@exаmple.org T ０２０ ７９４６ ０７４３ Ö"  # an invisible character, a Cyrillic letter, full-width digits
    assert got(text) == {("email", "se\u200blya@exаmple.org"), ("phone", "０２０ ７９４６ ０７４３")}
    assert replace(text, NAMES) == "x\u200b mailto:[EMAIL] T [PHONE] Ö"


def test_frames(spark):
    text = "Ulwen Pellubrek, a@b.example, a@b.example"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "nothing " * 50_000 + "a@b.example", "x")], "doc_id long, text string, pii_type string")
    lex = spark.createDataFrame([(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY] + [(None, "given")], "name string, name_kind string")
    rows = sorted({(r.doc_id, r.pii_type, r.pii_value) for r in find_personal(docs, lex).collect()})
    assert rows == [(1, "email", "a@b.example"), (1, "name", "Ulwen Pellubrek"), (4, "email", "a@b.example")]
    out = {r.doc_id: r.text for r in replace_personal(docs, lex).collect()}
    assert out[1] == "[NAME], [EMAIL], [EMAIL]" and out[2] is None and out[3] == ""
    assert find_personal(docs.limit(0), lex).collect() == []
    assert {r.pii_type for r in find_personal(docs, lex.limit(0)).collect()} == {"email"}
    with pytest.raises(ValueError):
        find_personal(docs, lex, max_names=3)


@pytest.mark.parametrize("text, value", [
    ("write john dot doe at example dot com.", "john dot doe at example dot com"), ("(j [dot] p [dot] doe [at] mail [dot] example [dot] org)", "j [dot] p [dot] doe [at] mail [dot] example [dot] org")])
def test_spelled_local_part(text, value):
    assert got(text) == {("email", value)}


@pytest.mark.parametrize("text, kind, value", [
    ("phone: five five five one two three four five six seven", "phone", "five five five one two three four five six seven"), ("write to jane dot doe at example dot com.", "email", "jane dot doe at example dot com"),
    ("mail jane.doe at example dot berlin", "email", "jane.doe at example dot berlin"), ("look at the dot plot", None, None), ("jane [at] example [dot] org", "email", "jane [at] example [dot] org"),
    (f"lived in {'Ober' * 40}felder Weg 12 then", "address", f"{'Ober' * 40}felder Weg 12")])
def test_disguises(text, kind, value):
    assert got(text) == ({(kind, value)} if kind else set())


def test_rewriting_keeps_places():
    text = "a jane dot doe at example dot com b phone: one two three four five six seven eight nine zero, end"
    assert [text[a:b] for a, b, _ in detect(text, None)] == ["jane dot doe at example dot com", "one two three four five six seven eight nine zero"]
    assert replace(text, None) == "a [EMAIL] b phone: [PHONE], end"
