import pytest
from pyspark.sql import functions as F

from foliospark.llm import sentences as S


def units(text):
    out, begin = [], 0
    for e in S.ends_of(text):
        out.append(text[begin:e].strip())
        begin = e
    return out


CASES = [
    # abbreviations, decimals, initials
    ["Dr. Brown paid $4.5 million, i.e. below cost, to Acme Inc. of St. Louis.", "See Note 6.8 and Sec. 1.11 of No. 4."],
    ["It closes at 6 p.m.", "The U.S. market is open.", "Most income arises in the U.S.", "Acme Corp. acted."],
    ["It is idle (so says L. E. Smith).", "See Items 4.A. and 1.B. of the filing.", "Sold to Acme et al.", "As of Dec. 31, it held."],
    ["Who pays?", "Is the plant idle? is a question W. de Cel asked.", "The airbag ... was idle.", "We waited...", "Then we left."],
    # quotations and brackets
    ['"We held it. Nobody left," said M. M. Vel, our officer.', "He wrote: \"It stays.\"", "Our unit closed.", "(The plant was shut.)", "It was (approx. 223 sq. ft.) small."],
    ["Three apply: (i) consent; (ii) cover of $12.8 million; and (iii) an audit.", "Net loss."],
    # other languages
    ["Das gilt u. a. für Mor usw.", "Die Bank prüfte z. B. Pressen bzw. Lizenzen um ca. 12,5 Prozent auf 71,0 Mio. Euro.", "Seit dem 8. März gilt es.", "Ab dem 1. Quartal stieg er um 5.", "„Wir warten. Wir zahlen später“, sagte Dar."],
    ["Cela vise X, ses filiales, etc.", "L'usine a payé env. 8,5 millions !", "Pourquoi ?", "« Nous attendons. Rien ne presse », a dit Mme Tas."],
    ["¡Llegó a 5,2 puntos!", "¿Por qué?", "Véase el anexo 4.7, pág. 779.", "Fuera de EE. UU., la Sra. Dar pagó, p. ej., poco."],
    ["Это касается складов и т. д.", "В 2001 г. завод, т. е. общество, купил до 5,1 млн руб. в год.", "«Мы ждём. Спешить некуда», — сказал директор."],
    ["डॉ. वर्मन ने रु. 6.8 करोड़ दिए।", "“हम रुकेंगे। जल्दी नहीं है” उसने कहा।"],
    ["هل انتهى النزاع؟", "انظر الملحق 8.7، ص. 104.", "«ننتظر. لا داعي للعجلة» قال المدير."],
]


@pytest.mark.parametrize("want", CASES)
def test_sentences(want):
    assert units(" ".join(want)) == want


def test_scripts_without_spaces():
    assert units("经理说：“我们等。不着急。”然后离开。董事会检查了短期借款！") == ["经理说：“我们等。不着急。”然后离开。", "董事会检查了短期借款！"]
    assert units("社長は「待つ。急がない。」と述べた。銀行は更新した。") == ["社長は「待つ。急がない。」と述べた。", "銀行は更新した。"]
    assert units("ธนาคารขายที่ดิน โรงงาน(โครงการ)เพิ่มสต็อก80.0ล้านบาท  ในปี2020บริษัทลด") == ["ธนาคารขายที่ดิน", "โรงงาน(โครงการ)เพิ่มสต็อก80.0ล้านบาท", "ในปี2020บริษัทลด"]


def test_layout():
    assert units("Item 1A. Risk Factors\nWe sell. We buy\n- one thing\n- Mr. Two\n\nA table | 1 | 2\nB | 3 | 4") == ["Item 1A. Risk Factors", "We sell.", "We buy", "- one thing", "- Mr. Two", "A table | 1 | 2", "B | 3 | 4"]
    wrapped = "The joint venture with the northern port authority disposed\nof the archive ratio compared with 2007, and we may not\nrecover the costs. The auditor of Acme Ltd. looked into the\nbooks of the U.S. unit."
    assert [u.replace("\n", " ") for u in units(wrapped)] == ["The joint venture with the northern port authority disposed of the archive ratio compared with 2007, and we may not recover the costs.", "The auditor of Acme Ltd. looked into the books of the U.S. unit."]
    assert units("terms were unchanged.At year end, we left.See www.acme.example/a.html now") == ["terms were unchanged.", "At year end, we left.", "See www.acme.example/a.html now"]


def test_capitals_go_on_after_quotations_and_omissions():
    assert units('IT ENDS. "IS THE BEACON SAFE?" ASKED MS. NYR OF THE BOARD. THE FREIGHT ... WAS MATERIAL FOR 2 WEEKS. SEE BELOW.') == ["IT ENDS.", '"IS THE BEACON SAFE?" ASKED MS. NYR OF THE BOARD.', "THE FREIGHT ... WAS MATERIAL FOR 2 WEEKS.", "SEE BELOW."]


def test_titles_above_a_wrapped_paragraph():
    text = "Legacy Toothbrush And Vaccine Handset of Jasombrafen\n35.0% of the revenue in the year came from the north, and\nthe rest of it came from leases of the southern ports\nand of the plants."
    assert [u.replace("\n", " ") for u in units(text)] == ["Legacy Toothbrush And Vaccine Handset of Jasombrafen", "35.0% of the revenue in the year came from the north, and the rest of it came from leases of the southern ports and of the plants."]


def test_capitals():
    assert units("THE AUDITOR OF ACME INC. EXPANDED THE U.S. MARKET. TO DATE, IT HELD.") == ["THE AUDITOR OF ACME INC. EXPANDED THE U.S. MARKET.", "TO DATE, IT HELD."]


CAPITALS = [
    # what closes a list or gives a time
    ["ESTO AFECTA A MOR, SUS FILIALES, ETC.", "LA DIVISIÓN VENDIÓ LA PLANTA."],
    ["ESTO AFECTA A MOR, SUS FILIALES, ETC.", "SIN PARTIDAS EXTRAORDINARIAS, EL PROVEEDOR PAGÓ."],
    ["ISTO ABRANGE A MOR, AS SUAS FILIAIS, ETC.", "DESDE MARÇO, O ARRENDADOR PAGOU."],
    ["CELA VISE X, SES FILIALES, ETC.", "PRÈS DE 5 USINES ONT FERMÉ."],
    ["DAS GILT FÜR MOR USW.", "LAGERBESTÄNDE SANKEN."],
    ["ЭТО КАСАЕТСЯ СКЛАДОВ, ПОРТОВ И Т. Д.", "ЗАВОД ПРОДАЛ ЗАПАСЫ."],
    ["THE PLANT SOLD PRESSES, TOOLS, ETC. AND LEFT.", "IT CLOSES AT 6 P.M.", "VELMOR ACTED."],
    # openers, leads with a subject, companies' names
    ["THE UNIT WAS SOLD TO MOR INC.", "ALL PLANTS CLOSED.", "MOST INCOME ARISES IN THE U.S.", "NOBODY LEFT.", "IT WENT TO DAR ET AL.", "MANY STAYED."],
    ["THE UNIT WAS SOLD TO MOR INC.", "UNDER SEC. 10.9 OF THE AGREEMENT, OUR PLANT CLOSED.", "IT WENT TO MOR INC.", "DAR INC. PAID.", "INCOME ARISES IN THE U.S.", "IS THE ZINC SAFE?"],
    # a sentence goes on
    ["DAR CORP. SOLD THE KILN OF MOR CO. AT THE VEL EXCHANGE, WHILE VOLUMES FELL.", "DAR CORP. SOLD THE KILN OF MOR CO. IN CASH AND CREDITS, OFFSET BY GAINS."],
    ["DAR SOLD THE KILN OF MOR CO. (APPROX. 739 SQ. FT.), WHILE VOLUMES FELL.", "DAR SOLD THE KILN OF MOR CO. (SEE NOTE 2.7) SO THAT RISK IS LIMITED.", "DAR SOLD THE KILN OF MOR CO. WITHOUT RECOURSE, A 61.8-POINT CHANGE FROM 2010."],
    ["ЗАВОД КУПИЛ ДО 5,1 МЛН РУБ. В ГОД.", "В 2001 Г. НАШ ПАРТНЁР ПРОДАЛ ПАТЕНТЫ И ДР. ПРАВА ПО СТАВКЕ."],
    ['"THE CHILLER STAYS MODULAR."', "VELMOR ACQUIRED IT."],
]


@pytest.mark.parametrize("want", CAPITALS)
def test_texts_in_capitals(want):
    assert units(" ".join(want)) == want


def test_ends_are_counted_in_code_points_and_never_white_space():
    text = "  \U0001f4c8 up. \r\n\r\n down \U0001f4c8  "
    assert S.ends_of(text) == [7, 19]
    assert S.ends_of("") == [] and S.ends_of(" \n　") == []
    assert S.ends_of("x" * 100_000) == [100_000]
    assert S.ends_of('an open " quote. And more. (never closed. So') == [16, 41, 44]


def test_operator_handles_nulls_and_counts(spark):
    docs = spark.createDataFrame([(1, "A. Smith left. He ran."), (1, "A. Smith left. He ran."), (2, None), (3, ""), (None, "One.")], "doc_id bigint, text string").withColumn("ends", F.lit(1)).withColumn("end_pos", F.lit(1))
    assert sorted(map(tuple, S.sentence_boundaries(docs).where("doc_id is not null").collect())) == [(1, 14), (1, 14), (1, 22), (1, 22)]
    assert S.sentence_boundaries(docs).where("doc_id is null").count() == 1
    assert S.split_sentences(docs.limit(0)).count() == 0
    assert [r["sentence"] for r in S.split_sentences(docs.where("doc_id is null")).collect()] == ["One."]
    sections = spark.createDataFrame([("a", "1", "One. Two."), ("b", "1", "One."), (None, "1", "x")], "accession string, item string, text string")
    older = spark.createDataFrame([("a", "1", 3), ("a", "1", 3), ("a", "1", 9), ("a", "1", None)], "accession string, item string, n_sentences int")
    got = {r["accession"]: (r["n_units"], r["n_older"]) for r in S.against_older_counts(sections, older).collect()}
    assert got == {"a": (2, 3), "b": (1, None)}


def test_list_levels_open_go_on_and_close():
    next_items = S.next_items
    lines = ["1. one", "  (a) first", "  (b) second", "2. two", "plain words", "7. no next one", "3. not the next of 7", "Text", "4. no list any more"]
    blank = [True, False, False, False, False, False, False, True, False]
    assert next_items(lines, blank) == [False, False, True, True, False, False, False, False, False]
    assert next_items(["(h) eight", "(i) nine"], [True, False]) == [False, False]
    letters = [f"({c}) x" for c in "abcdefghij"]
    assert next_items(letters, [True] * 10) == [False] + [True] * 9
    assert next_items([], []) == []


def test_the_next_item_of_an_open_list_begins_a_unit():
    first = "(1) the company agreed to sell the harbor land and the old machines of the"
    text = "\n".join([first, "northern plant to a local partner for cash, and the partner agreed to pay", "(2) the rest of the price within five years after the sale of the land was", "entered in the register."])
    assert text.index("(2)") in [e + 1 for e in S.ends_of(text)]
