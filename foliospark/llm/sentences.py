"""Sentence boundaries for many languages and layouts (problem 3).

A text is first cut where its layout ends a unit: paragraphs, headings, list items and table rows. Line breaks inside a
hard-wrapped paragraph are white space. Each piece then goes through a pushdown automaton that visits only its events:
terminators, brackets and quotation marks. Its stack holds the open brackets and quotations (an opening sign with no partner
in the piece is ordinary text), and no unit ends while the stack holds anything. A full stop is looked up in a trie of
abbreviations, read backwards from the stop; scripts have their own terminators, and Thai ends sentences by a space. The
levels of lists have a stack of their own, by lines: the next item of an open list never goes on from the line before it.

The automaton emits offsets in code points; the text of a unit is cut out by them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm._arrow import each_batch, list_of

# Abbreviations, without the last full stop, in lower case.
#: After these a sentence goes on, whatever follows.
NEVER = (
    "dr mr mrs ms messrs prof st rev hon gen capt fig figs sec secs ex exs reg ref approx vs cf e.g i.e att attn vol pp p sq viz "
    "bzw z.b ca mio mrd nr abs art d.h evtl ggf inkl vgl abb dipl "
    "aprox ej pág pag pags sr sra srta dña núm ee env mme mlle "
    "т е ст стр прил млн млрд гл рис табл см ул напр тыс "
    "डॉ रु श्री ص"
).split()
#: After these a sentence goes on before a figure.
BEFORE_FIGURE = "no nos jan feb mar apr jun jul aug sep sept oct nov dec note item items part п".split()
#: After these a sentence may end, if a capital follows that is no further word of a text in capitals.
MAY_END = "inc corp co ltd ltda llc plc gmbh s.a al jr u.s u.k u.s.a uu др руб ft".split()
#: After these a sentence ends before a capital, in a text in capitals too.
CLOSING = "etc usw p.m a.m д".split()
#: After these a text in capitals goes on: a year stands before what it dates.
YEAR = ["г"]
COMPANY = frozenset("inc corp co ltd ltda llc plc gmbh s.a".split())
# The closed classes of the cased languages of the corpus, by which texts in capitals are cut after an abbreviation.
#: Articles, pronouns, other words before a noun, question words, titles, references and "management", which has no article: what follows an abbreviation begins anew.
OPENERS = frozenset(
    "a an the this that these those each every all both some any no none neither nobody nothing most many few several such other others another one two three four five six seven eight nine ten "
    "i you he she it we they my your his her its our their who what why how where there here dr mr mrs ms messrs see management "
    "der die das dem den ein eine einer eines einem einen dieser diese dieses jeder jede jedes kein keine alle wir er sie es ihr sein seine unser unsere wer warum siehe "
    "le la les un une des ce cet cette ces chaque tout toute tous toutes aucun aucune nous vous il elle ils elles son sa ses notre nos leur leurs qui pourquoi voir m mme mlle "
    "el los las una unos unas este esta estos estas ese esa cada todo toda todos todas ningún ninguna nosotros él ella ellos ellas su sus nuestro nuestra nuestros nuestras quién sr sra véase "
    "o os um uma uns umas este esse essa isto isso todo toda nenhum nenhuma nós ele ela eles elas seu sua seus suas nosso nossa nossos nossas quem ver veja "
    "мы вы он она оно они это этот эта эти тот та те каждый каждая каждое все весь вся всё наш наша наше наши его её их кто что почему никто ничто см".split()
)
#: Prepositions and words that begin a clause: they begin a sentence where a comma and a subject follow, else the sentence goes on.
LEADS = frozenset(
    "about above absent according across after against along although among as at based because before beginning behind below beneath beside besides between beyond by compared concerning considering despite due during except excluding "
    "following for from given if in including inside into like near of off on once onto out outside over past pending per regarding since subject than though through throughout to together toward towards under unless unlike until up upon via when where whereas while with within without "
    "ab am auf aus außer bei beim bis durch für gegen im laut mit nach neben ohne seit trotz über um unter vom von vor während wegen zu zum zur zwischen wenn weil obwohl falls da "
    "à au aux avant après avec chez contre dans de depuis dès devant du durant en entre hors malgré par parmi pendant pour sans sauf selon sous sur vers si lorsque quand comme puisque bien "
    "ante antes bajo con conforme contra del desde después durante hacia hasta mediante para pese por salvo según sin sobre tras al debido cuando aunque como "
    "até após apesar com da das do dos em na nas ao aos pela pelo perante segundo sem sob quando embora se "
    "в во на по с со из из-за от до для при после без несмотря согласно к ко о об у за под перед между через против кроме благодаря если когда хотя так поскольку".split()
)
#: Conjunctions and relatives: before these a sentence goes on.
JOINS = frozenset(
    "and or nor but yet so which whose whom plus und oder sowie aber sondern et ou mais dont y e u pero sino que mas и или а но либо который которая которое которые чем".split()
)
#: Verbs that begin a question, if a question mark comes next.
ASKING = frozenset("is are was were am do does did has have had can could will would shall should may might must".split())
MONTHS_DE = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())

PAIRS = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "(": ")", "（": "）", "[": "]", "【": "】", '"': '"'}
CLOSERS = frozenset(PAIRS.values()) | {"’", "'"}
SURE = frozenset("。！？｡।॥")
ENDS = frozenset(".!?…؟۔") | SURE

_EVENT = re.compile(r"[!?…؟۔。！？｡।॥“”„«»‹›「」『』《》()（）\[\]【】\"]|\.(?!\d)")
_THAI = re.compile(r"[ก-๛]")
_THAI_EVENT = re.compile(_EVENT.pattern + r"|(?<=[ก-ๅ็-๛\d)%”\"])\s+(?=[ก-๛(“\"])")
_LINE = re.compile(r"[^\n]+")
_ITEM = re.compile(r"\s*(?:[-–—•*·▪◦●○‣]\s|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})[.)]\s)")
_BRACKET_ITEM = re.compile(r"\s*(?:[-–—•*·▪◦●○‣]\s|\(?\d{1,3}[.)]\s)")
_MARKER = re.compile(r"(\s*)(?:([-–—•*·▪◦●○‣])|(\(?)(\d{1,3}|[A-Za-z]|[ivxIVX]{1,5})([.)]))\s")
_ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii", "xiii", "xiv", "xv"]
_HEADING = re.compile(r"(?:item|part)\s+[\dIVX]+\S*(?:\s|$)", re.IGNORECASE)
_HEAD_NUMBER = re.compile(r"(?:item|part)\s+\S{1,5}$", re.IGNORECASE)
#: German ordinals, as in "ab dem 1. Quartal".
_ORDINAL = re.compile(r"(?<!\w)(?:dem|den|der|des|am|im|vom|zum|zur|beim)\s+\d{1,2}$", re.IGNORECASE)
_WORD = re.compile(r"\S{1,240}")
_AROUND = ".,;:!?\"”“„«»’'()[]"
#: What ends a clause: a comma before a space, or a sign that ends more.
_CLAUSE_EVENT = re.compile(r",(?=\s)|[;:!?…]|\.(?=\s|$)")


def build_trie(words: list[tuple[str, str]]) -> dict:
    """Words by their characters from the last to the first; a word's kind stands under the empty string."""
    root: dict = {}
    for word, kind in words:
        node = root
        for c in reversed(word):
            node = node.setdefault(c, {})
        node[""] = kind
    return root


TRIE = build_trie([(w, "never") for w in NEVER] + [(w, "figure") for w in BEFORE_FIGURE] + [(w, "may") for w in MAY_END] + [(w, "close") for w in CLOSING] + [(w, "year") for w in YEAR])


def abbreviation(text: str, stop: int, begin: int) -> str:
    """The kind of the longest abbreviation that ends before the full stop at stop, or the empty string."""
    node, i, kind = TRIE, stop - 1, ""
    while i >= begin:
        c = text[i]
        node = node.get(c) or node.get(c.lower())
        if node is None:
            break
        if "" in node and (i == begin or not (text[i - 1].isalnum() or text[i - 1] == ".")):
            kind = node[""]
        i -= 1
    return kind


def _is_row(line: str) -> bool:
    return line.count("|") >= 2 or line.strip().count("\t") >= 2


def _is_title(line: str) -> bool:
    """A line of words that all begin with a capital but for a few small ones, and are not all capitals."""
    words = line.split()
    if len(words) < 3 or line.isupper():
        return False
    return not any(w[-1] in ENDS for w in words) and all(w[0].isupper() or w in ("of", "and", "the", "for", "in", "to") for w in words)


def _marker(line: str) -> tuple[int, str, int] | None:
    """(indent, kind, number) of the list marker a line begins with; a bullet's number is 0, a letter's its place, a roman one's is read."""
    m = _MARKER.match(line)
    if not m:
        return None
    space, bullet, opened, number, shut = m.groups()
    if bullet:
        return len(space), bullet, 0
    kind, low = opened + shut, number.lower()
    if number.isdigit():
        return len(space), "1" + kind, int(number)
    if low in _ROMAN:
        return len(space), ("i" if number.islower() else "I") + kind, _ROMAN.index(low) + 1
    if len(number) > 1:
        return None
    return len(space), ("a" if number.islower() else "A") + kind, ord(low) - 96


def next_items(lines: list[str], blank_before: list[bool]) -> list[bool]:
    """Which lines are the next numbered item of a list that is open there.

    The stack holds the open list levels, each with its indent, its kind of marker and its last number. A marker of an open
    level pops the levels inside it; another one pushes a level if it begins a list. A line without a marker that stands no
    deeper than the level after a blank line ends it.
    """
    stack: list[list] = []
    out = []
    for line, blank in zip(lines, blank_before):
        marker = _marker(line)
        known = False
        if marker:
            indent, kind, number = marker
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == indent and stack[k][1] == kind), -1)
            if at < 0 and kind[0] in "iI" and number == 1:  # (i) may go on (h)
                other = ("a" if kind[0] == "i" else "A") + kind[1:]
                at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][:2] == [indent, other] and stack[k][2] == 8), -1)
                if at >= 0:
                    number = 9
            if at >= 0:
                known = number == stack[at][2] + 1
                del stack[at + 1 :]
                stack[at][2] = number
            elif number <= 1:
                while stack and stack[-1][0] > indent:
                    stack.pop()
                stack.append([indent, kind, number])
        elif blank:
            indent = len(line) - len(line.lstrip())
            while stack and stack[-1][0] >= indent:
                stack.pop()
        out.append(known)
    return out


def pieces(text: str) -> list[tuple[int, int]]:
    """[start, end) of what the layout sets apart; line breaks inside hard-wrapped paragraphs do not part it."""
    lines = [m.span() for m in _LINE.finditer(text)]
    if len(lines) < 2:
        return lines
    wide = []  # (start, end, stripped, row, item), without blank lines; a blank line leaves a gap in the offsets
    blank_before = []
    gap = True
    last_end = -1
    for a, b in lines:
        body = text[a:b]
        stripped = body.strip()
        if a > last_end + 1:
            gap = True
        last_end = b
        if not stripped:
            gap = True
            continue
        wide.append((a, b, stripped, _is_row(body), bool(_ITEM.match(body))))
        blank_before.append(gap)
        gap = False
    if not wide:
        return []
    next_item = next_items([text[a:b] for a, b, *_ in wide], blank_before) if any(w[4] for w in wide) else [False] * len(wide)
    joins = [False] * len(wide)  # line k goes on from line k - 1
    candidates = sure = 0
    for k in range(1, len(wide)):
        if blank_before[k]:
            continue
        _, _, a, row_a, _ = wide[k - 1]
        _, _, b, row_b, _ = wide[k]
        if row_a or row_b or a[-1] in ENDS or a[-1] in CLOSERS or not 40 <= len(a) <= 100:
            continue
        last = a.rsplit(None, 1)[-1]
        if _BRACKET_ITEM.match(b) or len(b.split(None, 1)[0]) > 60 or _THAI.search(a[-12:]) or _HEADING.match(a) or "/" in last or "@" in last:
            continue
        candidates += 1
        full = len(a) + 1 + len(b.split(None, 1)[0]) > 55
        if b[0].islower() or (full and not b[0].isupper()) or (full and len(a) <= 85 and len(b) <= 130 and (last.islower() or a.isupper() and b.isupper())):
            sure += 1
    if sure >= 1 and sure >= 0.25 * candidates:
        for k in range(1, len(wide)):
            if blank_before[k]:
                continue
            _, _, a, row_a, _ = wide[k - 1]
            _, _, b, row_b, _ = wide[k]
            if next_item[k] or row_a or row_b or _HEADING.match(a) or (not b[0].islower() and _is_title(a)):
                continue
            if b[0].islower() and a[-1] not in ENDS:
                joins[k] = True
                continue
            word = len(b.split(None, 1)[0])
            if len(a) < 20 or len(a) + 1 + word <= 52 or len(a) > 130 or word > 60:
                continue
            if _BRACKET_ITEM.match(b) and a[-1] in ENDS:
                continue
            joins[k] = True
    out: list[list[int]] = []
    for k, (a, b, _, _, _) in enumerate(wide):
        if joins[k]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _begins(text: str, i: int, end: int) -> bool:
    """Whether what stands at i may begin a sentence: no small letter, but for names like eBay, and no further punctuation."""
    while i < end and (text[i] in PAIRS or text[i] in "'‘¿¡*•–—-"):
        i += 1
    if i >= end:
        return True
    c = text[i]
    if c.islower():
        return i + 1 < end and text[i + 1].isupper()
    return c not in ",;:.!?)]}%،؛"


def _word_at(text: str, i: int) -> str:
    """The word at i without the punctuation around it, in lower case."""
    word = _WORD.match(text, i)
    return word.group().strip(_AROUND).lower() if word else ""


def _full_stop(text: str, at: int, begin: int) -> bool:
    """Whether the sign at `at` ends a sentence and is not that of an abbreviation."""
    return text[at] in ENDS and not (text[at] == "." and abbreviation(text, at, begin))


def _clause_follows(text: str, i: int, end: int) -> bool:
    """Whether the clause that a lead at i begins goes on, after a comma, with a subject."""
    for m in _CLAUSE_EVENT.finditer(text, i, min(end, i + 200)):
        at = m.start()
        if m.group() != ",":
            if text[at] == "." and (abbreviation(text, at, i) or at - 2 < i or not text[at - 2].isalnum()):
                continue
            return False
        nxt = m.end()
        while nxt < end and text[nxt].isspace():
            nxt += 1
        word = _word_at(text, nxt)
        second = _WORD.match(text, nxt)
        after = second.end() if second else nxt
        while after < end and text[after].isspace():
            after += 1
        # A participle, as in "offset by", is no subject, and a measure, as in "a 5-point change", stands beside one.
        if word in ("a", "an") and after < end and text[after].isdigit():
            return False
        return bool(word) and word not in JOINS and word not in LEADS and (word in OPENERS or _word_at(text, after) not in LEADS - {"of"})
    return False


def _opens_in_capitals(text: str, after: int, end: int, closed: bool) -> bool:
    """In a text in capitals: whether a sentence begins at after. closed: what is before would end one, whatever follows."""
    w = _word_at(text, after)
    if after < end and text[after] in "([（":
        shut = text.find(PAIRS[text[after]], after, end)
        return shut > 0 and _full_stop(text, shut - 1, after)
    if w in JOINS:
        return False
    if closed or w in OPENERS:
        return True
    if w in LEADS:
        return _clause_follows(text, after, end)
    if w in ASKING:
        return next((m.group() == "?" for m in _CLAUSE_EVENT.finditer(text, after, min(end, after + 200)) if m.group() != ","), False)
    # A company's name right after another name.
    word = _WORD.match(text, after)
    return bool(word) and word.group()[-1] not in ",;:" and _word_at(text, word.end() + 1) in COMPANY


def _goes_on_in_capitals(text: str, at: int, after: int, end: int) -> bool:
    """In a text in capitals: whether the next word begins no sentence. A quotation or a bracket that ends by a full stop ends one."""
    word = _WORD.match(text, after)
    w = word.group().strip(_AROUND) if word else ""
    before = re.search(r"[^\W\d_]{2}[^\w]*$", text[max(0, at - 8) : at])
    closed = text[at] in CLOSERS and text[at - 1] == "." and _full_stop(text, at - 1, max(0, at - 40))
    return bool(before) and before.group()[:2].isupper() and len(w) > 1 and w.isupper() and not _opens_in_capitals(text, after, end, closed)


def _stop_ends(text: str, at: int, after: int, end: int, begin: int, spaced: bool) -> bool:
    """Whether the full stop at `at` ends a sentence; after: where the next sign stands."""
    kind = abbreviation(text, at, begin)
    if kind == "never":
        return False
    nxt = text[after] if after < end else ""
    if kind == "figure" and nxt.isdigit():
        return False
    if kind in ("may", "close", "year"):
        word = _WORD.match(text, after)
        capitals = text[at - 1].isupper() and text[max(begin, at - 2)].isupper()
        if word:
            w = word.group().strip(_AROUND)
            if (len(w) > 1 or capitals) and w.isupper() and (kind == "year" or not _opens_in_capitals(text, after, end, kind == "close")):
                return False
        return True
    prev = text[at - 1] if at > begin else ""
    if prev.isalpha() and (at - 2 < begin or not (text[at - 2].isalnum() or unicode_mark(text[at - 2]))):
        # One letter alone: an initial, or a letter of an abbreviation that is written apart.
        return not prev.isupper() and not spaced
    if prev.isdigit() or prev in "ABCabc":
        head = text[max(begin, at - 12) : at]
        if _HEAD_NUMBER.search(head):
            return False
        if at - begin < 8 and _ITEM.fullmatch(text[begin : at + 1] + " "):
            return False
        if _ORDINAL.search(head):
            return False
        if prev.isdigit() and (at - 3 < begin or not text[at - 3].isdigit() or not text[at - 2].isdigit()):
            word = _WORD.match(text, after)
            if word and word.group().strip(".,;").lower() in MONTHS_DE:
                return False
    return True


def unicode_mark(c: str) -> bool:
    """Combining signs, as the vowel signs of Indic scripts, which isalnum() leaves out."""
    return "̀" <= c <= "ͯ" or "ऀ" <= c <= "ൿ" and not c.isspace() and c not in SURE


def ends_of(text: str) -> list[int]:
    """The end of each unit: the number of code points up to and including its last character, which is no white space."""
    out: list[int] = []
    thai = bool(_THAI.search(text))
    for start, stop in pieces(text):
        seg_end = start + len(text[start:stop].rstrip())
        begin = start + len(text[start:stop]) - len(text[start:stop].lstrip())
        if begin >= seg_end:
            continue
        unit = begin
        stack: list[tuple[str, int]] = []
        shuts: dict[str, int] = {}  # the next place of each closing sign, so that none is looked for twice
        skip = -1
        for m in (_THAI_EVENT if thai else _EVENT).finditer(text, begin, seg_end):
            at = m.start()
            if at < skip:
                continue
            c = text[at]
            if c.isspace():  # Thai
                if not stack and at > unit and not (at - unit < 8 and _ITEM.fullmatch(text[unit:at] + " ")):
                    out.append(at)
                    unit = m.end()
                continue
            if stack and c == stack[-1][0]:
                _, opened = stack.pop()
                if stack or opened > unit and c not in "”“\"»」』’":
                    if not (not stack and text[at - 1] in ENDS and opened == unit):
                        continue
                # A quotation or a bracket that holds whole sentences ends with its closing sign.
                if text[at - 1] not in ENDS:
                    continue
                p = at + 1
            elif c in PAIRS:
                close = PAIRS[c]
                shut = shuts.get(close, 0)
                if 0 <= shut <= at:
                    shut = shuts[close] = text.find(close, at + 1, seg_end)
                if shut > 0 and c != close:
                    again = text.find(c, at + 1, shut)
                    if again > 0 and c not in "(（[":
                        shut = -1
                if c == '"' and at > begin and text[at - 1].isalnum():
                    shut = -1
                if shut > 0:
                    stack.append((close, at))
                continue
            elif c in ENDS:
                if stack:
                    continue
                p = at + 1
                while p < seg_end and text[p] in ENDS:
                    p += 1
                skip = p
                while p < seg_end and text[p] in CLOSERS and text[p] not in "\"'":
                    p += 1
                if p < seg_end and text[p] in "\"'" and (p + 1 >= seg_end or text[p + 1].isspace()):
                    p += 1
            else:
                continue
            if p >= seg_end:
                break
            after = p
            while after < seg_end and text[after].isspace():
                after += 1
            spaced = after > p
            if c in SURE:
                pass
            elif c in CLOSERS:
                if not spaced or not _begins(text, after, seg_end) or _goes_on_in_capitals(text, at, after, seg_end):
                    continue
            else:
                last = text[p - 1]
                if (p - at >= 3 or c == "…") and at > begin and text[at - 1].isspace() and _goes_on_in_capitals(text, at, after, seg_end):
                    continue
                if not _begins(text, after, seg_end):
                    continue
                if not spaced:
                    # No space after the stop: a letter must follow, in words, not in addresses and numbers.
                    nxt = text[after]
                    if not (nxt.isalpha() or nxt in PAIRS or nxt in "¿¡"):
                        continue
                    if c == "." and nxt.isalpha() and nxt.isupper():
                        follows = text[after + 1] if after + 1 < seg_end else " "
                        if not (follows.islower() or follows.isspace()) and not (follows.isupper() and text[at - 1].islower()):
                            if not (follows.isupper() and text[max(begin, at - 3) : at].isupper()):
                                continue
                        elif text[at - 1].isupper() and not text[at - 2 : at].isupper() and not text[max(begin, at - 3) : at - 1].endswith("."):
                            continue
                    near = max(begin, at - 200)
                    word = _WORD.match(text, max(text.rfind(" ", near, at) + 1, text.rfind("\n", near, at) + 1, near))
                    run = word.group() if word else ""
                    if "/" in run or "@" in run or run.lower().startswith("www."):
                        continue
                if c == "." and last == "." and p - at == 1 and not _stop_ends(text, at, after, seg_end, unit, spaced):
                    continue
            out.append(p)
            unit = after
        if unit < seg_end:
            out.append(seg_end)
    return out


def sentence_ends(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ends array<int>) of every row: the ends of the units of its whole text in order.

    An empty list for a null, empty or blank text. Null and repeated ids give a row for each row; an empty table gives no
    rows; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [ends_of(t) if t else [] for t in batch.column(1).to_pylist()]
        flat = np.array([e for row in found for e in row], dtype=np.int32)
        return pa.RecordBatch.from_arrays([batch.column(0), list_of(flat, [len(r) for r in found])], schema=pa.schema([("doc_id", pa.int64()), ("ends", pa.list_(pa.int32()))]))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each_batch(run, "text"), "doc_id bigint, ends array<int>")


def sentence_boundaries(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, end_pos): one row for each unit of each text that is not blank."""
    return sentence_ends(docs, id_col=id_col, text_col=text_col).select("doc_id", F.explode("ends").alias("end_pos"))


def split_sentences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sent_no, end_pos, sentence): the units themselves, from 0, without the white space between them."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, nos, ends, units = [], [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            begin = 0
            for no, e in enumerate(ends_of(t) if t else []):
                ids.append(i)
                nos.append(no)
                ends.append(e)
                units.append(t[begin:e].strip())
                begin = e
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int32()), pa.array(ends, pa.int32()), pa.array(units, pa.string())], names=["doc_id", "sent_no", "end_pos", "sentence"])

    schema = "doc_id bigint, sent_no int, end_pos int, sentence string"
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each_batch(run, "text"), schema)


def against_older_counts(docs: DataFrame, scored: DataFrame) -> DataFrame:
    """(accession, item, n_units, n_older): the units of a section beside the count of the older splitter in scored.

    scored has accession, item and n_sentences on each of its rows, at times null or wrong: the count that most rows of the
    section give is taken, the least of equally frequent ones. Sections without a count have null in n_older.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = [len(ends_of(t)) if t else 0 for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["accession", "item", "n"])

    named = docs.select("accession", "item", "text").where("accession is not null and item is not null")
    counted = named.mapInArrow(each_batch(run, "text"), "accession string, item string, n bigint").groupBy("accession", "item").agg(F.max("n").alias("n_units"))
    votes = scored.where("n_sentences is not null").groupBy("accession", "item", "n_sentences").count()
    older = votes.groupBy("accession", "item").agg(F.max_by(F.col("n_sentences").cast("bigint"), F.struct(F.col("count"), -F.col("n_sentences"))).alias("n_older"))
    return counted.join(older, ["accession", "item"], "left").select("accession", "item", "n_units", "n_older")
