"""Personal data: patterns of known forms, and a linear-chain conditional random field over word shapes.

The field tags the words of every line that holds a digit or an at sign. Its features are the shapes of a word and its
neighbours, how many digits it has, and which cue word stands before it; weights are fitted by gradient ascent on a small
labelled table: sentences of the caller's, or LABELLED with lines that silver_lines() draws from the corpus, in which the
patterns mark the data, which is also rewritten in forms and set in places that the patterns do not cover; runs of numbers that the
patterns leave are of unknown kind there, so they teach nothing. Tags of all lines of a batch are
decoded by Viterbi at once in numpy. What it tags, the patterns do not cover and passes the tests of its kind (digits, check
digit, parts) is added to their spans.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmerge.llm.common import over_batches, texts_of

KINDS = ("email", "ip", "card", "phone")

# The base patterns. What they match lies within runs of their own characters, which REGION and ADDRESS find.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The same, so that no character is tried twice: a match can only start where a run of digits does, or after the one before.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
REGION = re.compile(r"[+0-9][0-9 ().+-]*")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of the patterns; matches of one kind do not overlap, and one that fails its test is dropped."""
    found: list[Span] = []
    at, after = text.find("@"), 0
    while at >= 0:
        a = at
        while a > after and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at) if a < at else None
        if m:
            found.append((a, 0, m.end()))
        after = m.end() if m else at + 1
        at = text.find("@", after)
    for region in REGION.finditer(text):
        run, a = region.group(), region.start()
        if len(run) < 7:
            continue
        found += [(a + m.start(), 1, a + m.end()) for m in _IP.finditer(run) if all(len(p) < 4 and int(p or 0) < 256 for p in (x.lstrip("0") for x in m.group().split(".")))]
        for kind, pattern, least, most in ((2, CARD, 12, 19), (3, PHONE, 9, 15)):
            for m in pattern.finditer(run):
                digits = re.sub("[^0-9]", "", m.group())
                if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                    found.append((a + m.start(), kind, a + m.end()))
    return sorted(found)


# The labelled table. A stretch {kind:text} is personal data of that kind; all else is not.
LABELLED = (
    "please write to {email:anna.lee@mail.example.org} before noon",
    "mail: {email:j_smith42@uni.example.edu} or visit us",
    "contact {email:bo@x.example.com} for details .",
    "her address is {email:maria99@web.example.net} , she says",
    "meet @ noon in room 12",
    "the @ sign costs 5 cents",
    "price 3 @ 20 each , total 60",
    "host {ip:10.0.13.7} did not answer",
    "from {ip:192.168.100.24} port 8080",
    "client {ip:172.16.4.201} sent 512 bytes",
    "ping {ip:203.0.113.99} and {ip:198.51.100.3} now",
    "version 4.0.2 of the tool",
    "release 2.11.0 came in 2019",
    "section 3.2.1 on page 44",
    "under license 4.0 . see 2.0 too",
    "card {card:4539 1488 0343 6467} was declined",
    "paid with {card:6011000990139424} in May",
    "visa {card:4485-2757-4230-8327} expires soon",
    "charge {card:371449635398431} for 20 euro",
    "order 186126 has 44296 items",
    "population 1250000 in 1998",
    "id 730012345 , lot 22 , row 7",
    "account 12 of 480 was closed",
    "call {phone:+1 (555) 201-7788} today",
    "phone: {phone:+44 20 7946 0018} ext 4",
    "tel {phone:+49 30 5550 1234} or fax",
    "mobile {phone:(555) 340-2211} after six",
    "phone {phone:555-867-5309} at home",
    "dial {phone:+1-555-010-4477} for help",
    "ring {phone:(202) 555-0147} or {phone:+33 1 99 00 12 34}",
    "scores were 3-2 , 4-1 and 10-7",
    "from 1990-04-12 to 2003-11-30",
    "on 12/05/2014 at 10:45 we left",
    "pages 110-145 ( 2nd edition )",
    "he ran 10.5 km in 44:12 minutes",
    "rooms 204 and 1207 , floor 12",
    "the 3rd of 25 chapters has 9 figures",
    "| 4279 | 3557 | 91 |",
    "chapter 4 : 1 2 3 4 5 6 7",
    "in 2004 , 2005 and 2006 it rose by 12 %",
)
UNKNOWN = "any"
MARK = re.compile(r"\{(\w+):([^}]*)\}")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WORDS = re.compile(r"\S+")
#: A line with a digit or an at sign; its beginning is looked at once.
_LINE = re.compile(r"(?:(?<=\n)|\A)[^\n0-9@]*+[0-9@][^\n]*")
#: Words before personal data that count as a feature by themselves.
CUES = frozenset("call phone phone: tel mobile dial ring fax mail: contact card visa host ip from to or and order id page version on in the".split())
_KIND = str.maketrans({**{chr(c): "x" for c in range(97, 123)}, **{chr(c): "X" for c in range(65, 91)}, **{chr(c): "d" for c in range(48, 58)}})
_RUNS = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Classes of the characters, ASCII letters and digits by their kind and other letters as x, runs drawn together."""
    return _RUNS.sub(r"\1", "".join(c if c < "\x80" else "x" if c.isalpha() else c for c in word.translate(_KIND).rstrip(".,;:!?")))


def features(words: list[str]) -> list[list[str]]:
    """The features of each word of a line."""
    shapes = ["^", *map(shape, words), "$"]
    out = []
    for i, word in enumerate(words):
        digits = sum(c.isdigit() for c in word)
        before = words[i - 1].lower() if i else "^"
        out.append([f"s{shapes[i + 1]}", f"p{shapes[i]}|{shapes[i + 1]}", f"n{shapes[i + 1]}|{shapes[i + 2]}", f"d{min(digits, 12)}|{shapes[i + 1]}", f"d{min(digits, 12)}", f"c{before}|{shapes[i + 1]}" if before in CUES else "c"])
    return out


def tagged(sentence: str) -> tuple[list[str], list[int]]:
    """Words and tags of a marked-up sentence; -1 for words of a stretch {any:text}, of which nothing is known."""
    words, tags, at = [], [], 0
    for m in [*MARK.finditer(sentence), None]:
        plain = sentence[at : m.start() if m else None]
        words += (new := plain.split())
        tags += [0] * len(new)
        if m:
            words += (new := m.group(2).split())
            tags += [-1] * len(new) if m.group(1) == UNKNOWN else [1 + 2 * KINDS.index(m.group(1)) + (i > 0) for i in range(len(new))]
            at = m.end()
    return words, tags


class Field:
    """Weights of features by tag, and of tags by the tag before (row len(TAGS): the start)."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, lines: list[list[list[str]]]) -> np.ndarray:
        """lines x longest x tags, zero beyond the end of a line."""
        width = max(len(x) for line in lines for x in line)
        ids = np.full((len(lines), max(map(len, lines)), width), len(self.emit) - 1)
        for i, line in enumerate(lines):
            for j, names in enumerate(line):
                for k, name in enumerate(names):
                    ids[i, j, k] = self.index.get(name, -1)
        ids[ids < 0] = len(self.emit) - 1
        return self.emit[ids].sum(axis=2)

    def viterbi(self, lines: list[list[list[str]]]) -> list[list[int]]:
        """The best tags of each line, all lines of about one length at once."""
        out: list[list[int]] = [[] for _ in lines]
        groups = defaultdict(list)
        for i, line in enumerate(lines):
            if line:
                groups[len(line).bit_length()].append(i)
        for members in groups.values():
            for k in range(0, len(members), step := max(1, 20_000 // max(len(lines[i]) for i in members))):
                part = members[k : k + step]
                scores, lengths = self.scores([lines[i] for i in part]), np.array([len(lines[i]) for i in part])
                best, back = scores[:, 0] + self.move[-1], []
                for t in range(1, scores.shape[1]):
                    through = best[:, :, None] + self.move[None, :-1]
                    back.append(np.where((t < lengths)[:, None], through.argmax(axis=1), np.arange(len(TAGS))))
                    best = np.where((t < lengths)[:, None], through.max(axis=1) + scores[:, t], best)
                tag, path = best.argmax(axis=1), []
                rows = np.arange(len(part))
                path.append(tag)
                for pointers in reversed(back):
                    tag = pointers[rows, tag]
                    path.append(tag)
                for row, i in enumerate(part):
                    out[i] = [int(x[row]) for x in path[::-1][: len(lines[i])]]
        return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def _padded(data: list[tuple[list[list[str]], list[int]]], index: dict[str, int]):
    """Lines of about one length together: ids (line, place, feature), tags and lengths, padded."""
    groups = defaultdict(list)
    for line, tags in data:
        groups[(len(line) - 1) // 4].append((line, tags))
    for members in groups.values():
        longest = max(len(line) for line, _ in members)
        ids = np.full((len(members), longest, len(members[0][0][0])), len(index))
        truth, lengths = np.zeros((len(members), longest), int), np.array([len(line) for line, _ in members])
        for i, (line, tags) in enumerate(members):
            ids[i, : len(line)] = [[index[x] for x in names] for names in line]
            truth[i, : len(line)] = tags
        yield ids, truth, lengths


def _expected(scores: np.ndarray, move: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, place, tag): the chance of each tag; (tag, tag): how often the second is expected after the first. All lines at once."""
    (n, longest, tags), inner = scores.shape, move[:-1]
    fore = np.empty((n, longest, tags))
    fore[:, 0] = scores[:, 0] + move[-1]
    for t in range(1, longest):
        fore[:, t] = _log_sum(fore[:, t - 1, :, None] + inner[None], 1) + scores[:, t]
    aft = np.zeros((n, longest, tags))
    for t in range(longest - 2, -1, -1):
        told = _log_sum(inner[None] + (scores[:, t + 1] + aft[:, t + 1])[:, None, :], 2)
        aft[:, t] = np.where((t + 1 < lengths)[:, None], told, 0.0)
    whole = _log_sum(fore[np.arange(n), lengths - 1], 1)
    after = np.zeros((tags, tags))
    for t in range(1, longest):
        on = t < lengths
        after += np.exp(fore[on, t - 1, :, None] + inner[None] + (scores[on, t] + aft[on, t])[:, None, :] - whole[on, None, None]).sum(axis=0)
    return np.exp(fore + aft - whole[:, None, None]), after


def fit(sentences: list[str], rounds: int = 150, rate: float = 0.1, decay: float = 0.02) -> Field:
    """Maximises the likelihood of the known tags less decay / 2 times the squared weights, by Adam over all sentences.

    Words with an unknown tag count with every tag that they may have: the likelihood is a sum over all of them. Forward and backward
    sums run over all lines of about one length at once.
    """
    data = [tagged(s) for s in sentences]
    data = [(features(words), tags) for words, tags in data if words]
    index: dict[str, int] = {}
    for line, _ in data:
        for names in line:
            for name in names:
                index.setdefault(name, len(index))
    n, tags = len(index), len(TAGS)
    field = Field(index, np.zeros((n + 1, tags)), np.zeros((tags + 1, tags)))
    moment = [np.zeros_like(x) for x in (field.emit, field.emit, field.move, field.move)]
    groups = [g for part in ([x for x in data if min(x[1]) >= 0], [x for x in data if min(x[1]) < 0]) for g in _padded(part, index)]
    for step in range(1, rounds + 1):
        emit, move = -decay * field.emit, -decay * field.move
        for ids, truth, lengths in groups:
            longest = ids.shape[1]
            scores = field.emit[ids].sum(axis=2)
            free, after = _expected(scores, field.move, lengths)
            if truth.min() < 0:
                ruled_out = (truth[..., None] >= 0) & (np.arange(tags) != truth[..., None])
                given, told = _expected(np.where(ruled_out, -1e4, scores), field.move, lengths)
            else:
                given, told = np.eye(tags)[truth], np.zeros((tags, tags))
                for t in range(1, longest):
                    on = t < lengths
                    np.add.at(told, (truth[on, t - 1], truth[on, t]), 1)
            real = (np.arange(longest)[None] < lengths[:, None])[..., None]
            odds = np.where(real, given - free, 0.0)
            np.add.at(emit, ids, odds[:, :, None, :])
            move[-1] += odds[:, 0].sum(axis=0)
            move[:-1] += told - after
        emit[-1] = 0
        for k, (weight, slope) in enumerate(((field.emit, emit), (field.move, move))):
            moment[2 * k] = 0.9 * moment[2 * k] + 0.1 * slope
            moment[2 * k + 1] = 0.999 * moment[2 * k + 1] + 0.001 * slope**2
            weight += rate * (moment[2 * k] / (1 - 0.9**step)) / (np.sqrt(moment[2 * k + 1] / (1 - 0.999**step)) + 1e-8)
    return field


def _rewritten(kind: int, value: str, turn: int) -> str:
    """The same datum in another form: cards regrouped, phones with parentheses, dots or no plus sign; others as they are."""
    digits = re.sub("[^0-9]", "", value)
    if kind == 2:
        return (" ", ".", "/", "_")[turn % 4].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    if kind == 3 and len(digits) >= 10:
        area, mid, last = digits[-10:-7], digits[-7:-4], digits[-4:]
        return (f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"{area} {mid} {last}")[turn % 4]
    return value


#: Forms of a datum in marked_up(): as it stands, rewritten in four ways, between other numbers, said twice, and before an address.
FORMS = (None, 0, 1, 2, 3, 4, 5, 6)


def _told(kind: int, value: str, form: int | None) -> str:
    """A marked datum in one of FORMS; next to other numbers the patterns run on and miss it."""
    mark = f"{{{KINDS[kind]}:{value}}}"
    if form is None or form < 4:
        return f" {{{KINDS[kind]}:{value if form is None else _rewritten(kind, value, form)}}} "
    turn = zlib.crc32(value.encode())
    if kind < 2:
        return f" {mark} "
    if form == 4:
        return f" {turn % 90 + 3} {mark} {turn // 90 % 4000 + 2} "
    return f" {mark} {mark} " if form == 5 else f" {mark} {{ip:10.{turn % 250}.{turn // 250 % 250}.7}} "


def _unsure(plain: str) -> str:
    """Text without a datum of the patterns: runs of numbers that are long enough to hold one, and words with an at sign, are marked as unknown."""
    plain = plain.replace("{", "(").replace("}", ")")
    plain = REGION.sub(lambda m: f" {{{UNKNOWN}:{m.group()}}} " if sum(c.isdigit() for c in m.group()) >= 7 else m.group(), plain)
    return re.sub(r"(?<!\S)[^\s{}]*@[^\s{}]+", lambda m: f" {{{UNKNOWN}:{m.group()}}} ", plain)


def marked_up(line: str, form: int | None) -> str:
    """A line as a labelled sentence: what the patterns find, in one of FORMS; a window of 12 words on either side.

    The patterns do not decide what they miss: longer runs of numbers that they leave are unknown, not none.
    """
    spans, out, at = base_spans(line), [], 0
    kept: list[Span] = []
    for a, kind, b in spans:
        if not kept or a >= kept[-1][2]:
            kept.append((a, kind, b))
    for a, kind, b in kept:
        out += [_unsure(line[at:a]), _told(kind, line[a:b], form)]
        at = b
    told = "".join(out) + _unsure(line[at:])
    places = [m.start() for m in MARK.finditer(told) if m.group(1) != UNKNOWN] or [m.start() for m in re.finditer("[0-9]", told)][:1]
    if not places:
        return ""
    # words are counted with marks whole
    words = list(re.finditer(r"\{\w+:[^}]*\}|[^\s{]+", told))
    first, last = (sum(m.start() <= p for m in words) - 1 for p in (places[0], places[-1]))
    return " ".join(m.group() for m in words[max(0, first - 12) : min(last, first + 24) + 13])


def silver_lines(docs: DataFrame, max_lines: int = 600, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One string column `sentence` of at most max_lines labelled lines of the corpus, those with the least hash.

    Two thirds hold what the patterns find, in all FORMS; the rest hold digits or an at sign but nothing found.
    Each task keeps the least max_lines of what it reads and only these are shuffled; equal ones count once. Lines of over 2,000
    characters are not taken. An empty table, or one without digits, gives no rows.
    """
    shares = (max_lines - max_lines * 2 // 3, max_lines * 2 // 3)

    def run(batches):
        least: tuple[dict, dict] = ({}, {})
        for batch in batches:
            maybe = pc.match_substring_regex(batch.column(1), "[0-9@]")
            for text in batch.column(1).filter(maybe):
                for m in _LINE.finditer(text.as_py()):
                    line = m.group()
                    for form in FORMS if len(line) <= 2000 else ():
                        if sentence := marked_up(line, form):
                            least[any(f"{{{k}:" in sentence for k in KINDS)][sentence] = zlib.crc32(sentence.encode())
            for k, kept in enumerate(least):
                if len(kept) > shares[k]:
                    cut = sorted((h, x) for x, h in kept.items())[: shares[k]]
                    kept.clear()
                    kept.update((x, h) for h, x in cut)
        rows = [(h, x, k == 1) for k, kept in enumerate(least) for x, h in kept.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], ["h", "sentence", "found"])

    lines = texts_of(docs, id_col, text_col).mapInArrow(run, "h long, sentence string, found boolean").distinct()
    parts = [lines.where(F.col("found") == (k == 1)).orderBy("h", "sentence").limit(n).select("sentence") for k, n in enumerate(shares)]
    return parts[0].unionByName(parts[1])


def _entities(words: list[tuple[int, int]], tags: list[int]) -> list[Span]:
    """Spans of runs B, I, I... of one kind; a run may also start with I."""
    found, open_ = [], None
    for (a, b), tag in zip(words, tags, strict=True):
        kind, begins = (tag - 1) // 2, tag % 2 == 1
        if tag and open_ and not begins and open_[1] == kind:
            open_ = (open_[0], kind, b)
            continue
        if open_:
            found.append(open_)
        open_ = (a, kind, b) if tag else None
    return found + [open_] if open_ else found


def plausible(kind: int, value: str) -> bool:
    """What a span of the field must also satisfy: the number of digits, the check digit of cards, the parts of addresses."""
    digits = re.sub("[^0-9]", "", value)
    if kind == 0:
        return "@" in value.strip("@")
    if kind == 1:
        return bool(IP.fullmatch(value)) and all(len(p) < 4 and int(p) < 256 for p in value.split("."))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return 7 <= len(digits) <= 15


def all_spans(texts: list[str], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and these with what the field adds."""
    base = [base_spans(x) for x in texts]
    lines, places = [], []
    for i, text in enumerate(texts):
        for line in _LINE.finditer(text):
            words = [(line.start() + m.start(), line.start() + m.end()) for m in WORDS.finditer(line.group())]
            lines.append(words)
            places.append(i)
    tags = field.viterbi([features([texts[i][a:b] for a, b in words]) for i, words in zip(places, lines, strict=True)])
    more: list[list[Span]] = [[] for _ in texts]
    for i, words, found in zip(places, lines, tags, strict=True):
        for a, kind, b in _entities(words, found):
            b = a + len(texts[i][a:b].rstrip(".,;:!?"))
            if a < b and plausible(kind, texts[i][a:b]) and not any(s < b and a < e for s, _, e in base[i]):
                more[i].append((a, kind, b))
    return [(own, sorted(own + new)) for own, new in zip(base, more, strict=True)]


def find_personal_data(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 10_000) -> DataFrame:
    """(doc_id, base, spans) per row: arrays of (kind, start, end) in code points, end exclusive, by start and kind.

    labelled: one string column of marked-up sentences, at most max_labelled rows (more raise), e.g. silver_lines(); LABELLED is
    always part of the table. The field is fitted on it and sent to the tasks. Scan-local over whole texts. A null or empty
    text has no spans; a null doc_id stays null; rows that repeat each give a row; an empty table gives no rows; other columns
    are not read.
    """
    sentences = list(LABELLED)
    if labelled is not None:
        rows = labelled.select(F.col(labelled.columns[0]).cast("string")).limit(max_labelled + 1).collect()
        if len(rows) > max_labelled:
            raise ValueError(f"over {max_labelled} labelled sentences")
        sentences += sorted(r[0] for r in rows if r[0])
    field = fit(sentences)
    one = "array<struct<kind:string,start:int,end:int>>"

    def make():
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        told = lambda rows: pa.array([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans] for spans in rows], kind)

        def apply(batch: pa.RecordBatch) -> pa.RecordBatch:
            maybe = pc.match_substring_regex(batch.column(1), "[0-9@]")
            found = iter(all_spans(batch.column(1).filter(maybe).to_pylist(), field))
            both = [next(found) if x else ([], []) for x in maybe.to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), told([a for a, _ in both]), told([b for _, b in both])], ["doc_id", "base", "spans"])

        return apply

    return over_batches(texts_of(docs, id_col, text_col), make, f"doc_id long, base {one}, spans {one}")
