"""Personal data: base patterns, and a semi-Markov conditional random field that adds spans.

The base patterns (e-mail, IP address, card, phone) are found over the whole text. The field reads the regions that
could hold something else: runs of key characters, of digits and their separators, account numbers, and values set
to a password or the like. A region is a sequence of tokens. Its segments between places where an entity can begin and end are candidates for
each kind: those of up to MAX_TOKENS tokens, and whole stretches without a space however many tokens they have, so that
a long password or key is never cut. Segments with spaces are candidates in the shape of an account number or of a
telephone number of any country. Features of the whole segment and of what stands before it score it, transitions score neighbouring kinds, and dynamic programming picks the best cut, boundaries and kinds together.
The weights maximise the conditional likelihood of the cuts of lines made from templates; the gradient comes from
the forward-backward sums over all segmentations.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evistra.llm._common import slices, text_column

#: Kinds in the order of ties; those of the base patterns first.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "ssn", "iban", "local_phone")
#: Tokens of an entity that begins or ends inside a stretch without spaces, or holds spaces; characters of a candidate at
#: least; characters before it that are looked at for cues; marks that may stand around a whole stretch.
MAX_TOKENS, LEAST, BEFORE, AROUND = 12, 4, 40, 2
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ with its longest run of local characters; the same matches as a scan, in one pass."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping for each kind."""
    out = [(a, b, "email") for a, b in _emails(text)]
    if _DIGITS.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            d = _digits(m[0]) if m.end() - m.start() <= 40 else ""
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- the field -----------------------------------------------------------------------------------------------------

#: Words that announce a kind, lower case.
CUES = {
    "secret": frozenset(("token", "key", "apikey", "api_key", "secret", "password", "passwd", "pwd", "bearer", "access_token", "auth", "passwort", "contraseña")),
    "ssn": frozenset(("ssn", "social", "security")),
    "iban": frozenset(("iban", "account", "konto", "compte", "cuenta")),
    "local_phone": frozenset(("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "handy", "mobil", "ruf", "anruf", "téléphone", "portable", "appeler", "appelez", "teléfono", "móvil", "llame", "llamar", "tél")),
}
SHAPES = {
    "secret": re.compile(r"[A-Za-z0-9_+/=-]{16,}"),
    "ssn": re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "local_phone": re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
}
#: Telephone numbers as they are written in groups: pairs after a trunk digit, an area code and a number, threes and pairs.
PHONES = {
    "pairs": re.compile(r"0[1-9](?:[ .-][0-9]{2}){4}"),
    "area": re.compile(r"\(?0[1-9][0-9]{1,4}\)?[ /-]{1,3}[0-9]{3,8}(?:[ -][0-9]{2,5}){0,3}"),
    "threes": re.compile(r"[6-9][0-9]{2}(?:[ .-][0-9]{3}){2}|[6-9][0-9]{2}(?:[ .-][0-9]{2}){3}"),
}
ADDED = tuple(SHAPES)
_OTHER, _KINDS = 0, len(ADDED) + 1  # type 0 is a single token outside of any entity
_RUNS = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{16,}")
_NUMBERS = re.compile(r"(?<![0-9])\(?[0-9][0-9 ()./-]{4,}[0-9]")
_ACCOUNTS = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9 ]{8,}")
_SET = re.compile(r"""(?:password|passwd|pwd|passwort|secret|token|apikey|api_key)["']?[ \t]*[:=][ \t]*(?:"([^"\n]{4,})"|'([^'\n]{4,})'|["']?([^\s"',;]{4,}))""")
_SET_WORDS = ("password", "passwd", "pwd", "passwort", "secret", "token", "apikey", "api_key")
_SPACED = (SHAPES["iban"], SHAPES["local_phone"], *PHONES.values())  # shapes that may hold a space
_OPENERS = frozenset("=:")  # characters behind which an entity may begin, though a key could hold one of them
_MORE = re.compile(r" [A-Z0-9]{1,4}(?![A-Za-z0-9])")
_KEY_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-")
_QUOTES = frozenset("\"'")
_VOWELS = str.maketrans("", "", "aeiouyAEIOUY")
_NO_DIGITS, _NO_LETTERS = str.maketrans("", "", "0123456789"), re.compile(r"[A-Za-z]")


def regions(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Where the field looks, in order and disjoint: what could hold an entity, without the base spans."""
    found = [m.span() for m in _RUNS.finditer(text)]
    if _DIGITS.search(text):
        found += [m.span() for m in _NUMBERS.finditer(text)] + [m.span() for m in _ACCOUNTS.finditer(text)]
    low = text.lower() if len(text.lower()) == len(text) else text
    if any(w in low for w in _SET_WORDS):
        found += [m.span(m.lastindex) for m in _SET.finditer(low)]
    joined: list[list[int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    out, k, blocked = [], 0, []
    for a, b, _ in base:  # in order of their starts
        if blocked and a <= blocked[-1][1]:
            blocked[-1][1] = max(b, blocked[-1][1])
        else:
            blocked.append([a, b])
    for a, b in joined:
        while k < len(blocked) and blocked[k][1] <= a:
            k += 1
        i = k
        while i < len(blocked) and blocked[i][0] < b:
            if blocked[i][0] - a >= LEAST:
                out.append((a, blocked[i][0]))
            a = max(a, blocked[i][1])
            i += 1
        if b - a >= LEAST:
            out.append((a, b))
    return out


def features(span: str, before: str, after: str) -> list[str]:
    """Features of a whole candidate; before: the characters in front of it, after: a few behind it."""
    n = len(span)
    digits = n - len(span.translate(_NO_DIGITS))
    letters = n - len(_NO_LETTERS.sub("", span))
    upper = letters and span != span.lower()
    words = re.findall(r"\w+", before.lower())[-4:]
    counts = Counter(span)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    f = ["bias", f"long={min(n // 8, 5)}", f"share={digits * 4 // n}", f"letters={letters * 4 // n}", f"mixed={digits > 0 and letters > 0}"]
    f += [f"cue={k}" for k in ADDED if any(w in CUES[k] for w in words)] or ["cue=none"]
    f += [f"shape={k}" for k in ADDED if SHAPES[k].fullmatch(span)] or ["shape=none"]
    if digits >= 7:
        cued = any(w in CUES["local_phone"] for w in words)
        f += [f"phone={k}{cued}" for k, p in PHONES.items() if p.fullmatch(span)]
    f += [f"entropy={int(2 * entropy)}", f"case={bool(upper and span != span.upper())}", f"space={' ' in span}", f"slash={'/' in span}"]
    f += [f"upper={bool(letters) and span == span.upper()}", f"cut={before[-1:] in _KEY_CHARS}{after[:1] in _KEY_CHARS}"]
    f += [f"hyphens={min(counts.get('-', 0), 3)}", f"first={span[0].isalnum() or span[0] == '('}", f"last={span[-1].isalnum() or span[-1] == '='}"]
    f += [f"vowels={(n - len(span.translate(_VOWELS))) * 8 // letters if letters else -1}", f"set={before.rstrip(' ')[-1:] in ('=', ':') or (before[-1:] in _QUOTES and before[-2:-1] in ('=', ':', ' '))}"]
    known = f[-1]
    if digits and letters:
        f.append(f"set+mixed={known}")
    f += [f"{known}+ends={not after[:1].strip() or after[:1] in _QUOTES}+{span.count('(') - span.count(')')}", f"brackets={span.count('(') - span.count(')')}"]
    f += [f"more={k}" for k in ("iban",) if _MORE.match(after) and SHAPES[k].fullmatch(span)]
    return f


@dataclass
class Sequence:
    """A region's tokens and candidates: (first token, end token, start and end in the text, features)."""

    tokens: list[tuple[int, int]]
    candidates: list[tuple[int, int, int, int, list[str]]]


def sequence(text: str, a: int, b: int) -> Sequence:
    """A region's tokens, and the candidates: segments between places where an entity can begin and end.

    One can't begin or end inside a run of letters, digits and key characters, but for behind one of =: and at the ends
    of the region.
    """
    tokens = [(m.start() + a, m.end() + a) for m in _TOKEN.finditer(text[a:b])]
    n, made = len(tokens), []
    begins = [i == 0 or text[s - 1] not in _KEY_CHARS or text[s - 1] in _OPENERS for i, (s, _) in enumerate(tokens)]
    ends = [j == n - 1 or text[e] not in _KEY_CHARS for j, (_, e) in enumerate(tokens)]
    last = n - 1  # the last token of the stretch without a space that token i is in
    whole = [0] * n
    for i in range(n - 1, -1, -1):
        if i < n - 1 and tokens[i][1] < tokens[i + 1][0]:
            last = i
        whole[i] = last
    first = 0  # the first token of that stretch
    for i, (start, _) in enumerate(tokens):
        if i and tokens[i - 1][1] < start:
            first = i
        if not begins[i] or (start > 0 and text[start - 1].isalnum()):
            continue
        before = text[max(0, start - BEFORE) : start]
        upto = [j for j in range(i, min(i + MAX_TOKENS, n)) if ends[j]]
        if i - first <= AROUND:
            upto += [j for j in range(max(whole[i] - AROUND, i + MAX_TOKENS), whole[i] + 1) if ends[j] or j < whole[i]]
        for j in upto:
            end = tokens[j][1]
            if end - start < LEAST or text[end : end + 1].isalnum():
                continue
            span = text[start:end]
            if j <= whole[i] or any(p.fullmatch(span) for p in _SPACED):
                made.append((i, j + 1, start, end, features(span, before, text[end : end + 6])))
    return Sequence(tokens, made)


def _lse(x: np.ndarray, axis: int | None = None) -> np.ndarray:
    m = np.max(x, axis=axis, keepdims=True)
    m = np.where(np.isfinite(m), m, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(np.log(np.exp(x - m).sum(axis=axis, keepdims=True)) + m, axis=axis)


def forward_backward(n: int, spans: list[tuple[int, int]], scores: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log of the sum over all segmentations, each candidate's probability for each kind, expected transitions).

    A segmentation cuts the n tokens into candidates with a kind and single tokens outside; it begins and ends outside.
    """
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (i, j) in enumerate(spans):
        starts[i].append(c)
        ends[j].append(c)
    alpha = np.full((n + 1, _KINDS), -np.inf)
    into = np.full((n + 1, _KINDS), -np.inf)  # alpha with the transition to the next type
    alpha[0, _OTHER] = 0.0
    for j in range(n + 1):
        if j:
            alpha[j, _OTHER] = into[j - 1, _OTHER]
            if ends[j]:
                alpha[j, 1:] = _lse(np.array([into[spans[c][0], 1:] + scores[c] for c in ends[j]]), axis=0)
        into[j] = _lse(alpha[j][:, None] + trans, axis=0)
    total = float(into[n, _OTHER])
    beta = np.full((n + 1, _KINDS), -np.inf)
    rest = np.full((n + 1, _KINDS), -np.inf)  # from position i, with the next segment of a type
    beta[n] = trans[:, _OTHER]
    for i in range(n - 1, -1, -1):
        rest[i, _OTHER] = beta[i + 1, _OTHER]
        if starts[i]:
            rest[i, 1:] = _lse(np.array([scores[c] + beta[spans[c][1], 1:] for c in starts[i]]), axis=0)
        beta[i] = _lse(trans + rest[i][None], axis=1)
    at = np.array([into[i, 1:] + scores[c] + beta[j, 1:] - total for c, (i, j) in enumerate(spans)]).reshape(len(spans), _KINDS - 1)
    rest[n, _OTHER] = 0.0
    moves = np.exp(alpha[:, :, None] + trans[None] + rest[:, None, :] - total).sum(axis=0)
    return total, np.exp(at), moves


def best_cut(n: int, spans: list[tuple[int, int]], scores: np.ndarray, trans: np.ndarray) -> list[tuple[int, int]]:
    """The best segmentation's entities: (candidate, kind)."""
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (_, j) in enumerate(spans):
        ends[j].append(c)
    best, back = np.full((n + 1, _KINDS), -np.inf), {}
    best[0, _OTHER] = 0.0
    for j in range(n + 1):
        if j:
            best[j, _OTHER], back[j, _OTHER] = into[_OTHER], (None, int(come[_OTHER]), j - 1)
            for c in ends[j]:
                i = spans[c][0]
                for t in range(1, _KINDS):
                    s = paths[i][0][t] + scores[c][t - 1]
                    if s > best[j, t]:
                        best[j, t], back[j, t] = s, (c, int(paths[i][1][t]), i)
        else:
            paths: list[tuple[np.ndarray, np.ndarray]] = []
        moves = best[j][:, None] + trans
        into, come = moves.max(axis=0), moves.argmax(axis=0)
        paths.append((into, come))
    out, j, t = [], n, int(come[_OTHER])
    while j:
        c, before, i = back[j, t]
        if c is not None:
            out.append((c, t))
        j, t = i, before
    return out[::-1]


class Field:
    """Weights of the field: a row of kinds for each feature, and the transitions between types."""

    def __init__(self, weights: dict[str, np.ndarray], trans: np.ndarray):
        self.weights, self.trans = weights, trans

    def scores(self, seq: Sequence) -> np.ndarray:
        nothing = np.zeros(_KINDS - 1)
        return np.array([sum((self.weights.get(f, nothing) for f in c[4]), nothing) for c in seq.candidates]).reshape(-1, _KINDS - 1)

    def spans(self, text: str, a: int, b: int) -> list[tuple[int, int, str]]:
        seq = sequence(text, a, b)
        if not seq.candidates:
            return []
        scores = self.scores(seq)
        if scores.max() <= 0 and self.trans.max() <= 0:
            return []  # nothing outweighs staying outside
        cut = best_cut(len(seq.tokens), [c[:2] for c in seq.candidates], scores, self.trans)
        return [(*seq.candidates[c][2:4], ADDED[t - 1]) for c, t in cut]


def _examples() -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Made-up lines with their spans; {} in a template is an entity, {nK} are K digits and {wK} K small letters."""
    r = random.Random(7)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexa, num, lower = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz"
    upper, syllables = lower.upper(), ("en", "er", "ti", "on", "que", "sch", "ung", "ment", "re", "th", "and", "cion", "ado", "heit")
    alnum = upper + lower + num
    account = lambda gap: gap.join(["", *(pick(num if r.random() < 0.8 else upper + num, 4) for _ in range(r.randint(3, 6))), *([pick(num, r.randint(1, 3))] if r.random() < 0.8 else [])])
    made = {
        "secret": lambda: r.choice((
            pick(hexa, r.choice((32, 40, 64))), pick(alnum, r.randint(20, 48)), "sk_live_" + pick(alnum, 24), "AKIA" + pick(upper + num, 16), "AKIA" + pick(upper, 16), pick(alnum + "+/", 43) + "=",
            "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), "ghp_" + pick(alnum, r.randint(30, 300)),
            "-".join(pick(alnum, r.randint(4, 8)) for _ in range(r.randint(4, 9))), "/".join(pick(alnum + "+", r.randint(8, 30)) for _ in range(r.randint(2, 4))),
        )),
        "ssn": lambda: f"{pick(num, 3)}-{pick(num, 2)}-{pick(num, 4)}",
        "iban": lambda: r.choice(("DE", "FR", "ES", "GB")) + pick(num, 2) + account(r.choice(("", " "))),
        "local_phone": lambda: r.choice((f"({pick(num, 3)}) {pick(num, 3)}-{pick(num, 4)}", f"{pick(num, 3)}-{pick(num, 3)}-{pick(num, 4)}", f"{pick(num, 3)}.{pick(num, 3)}.{pick(num, 4)}")),
    }
    phone = lambda: r.choice((
        "0" + r.choice("123456789") + "".join(r.choice((" ", " ", ".")) + pick(num, 2) for _ in range(4)), "0" + r.choice("234569") + pick(num, r.randint(1, 3)) + r.choice((" ", "/", "-")) + pick(num, r.randint(5, 8)),
        r.choice("6789") + pick(num, 2) + " " + " ".join(pick(num, 2) for _ in range(3)), r.choice("6789") + pick(num, 2) + " " + pick(num, 3) + " " + pick(num, 3),
    ))
    with_entity = {
        "secret": ('the token = "{}" of', "api_key: {} and", "password={} then", 'secret = "{}"', "bearer {} was", "key {} here", "of {} thion"),
        "ssn": ("ssn {} of", "social security {} is", "number {} there", "in {} the"),
        "iban": ("iban {} for", "account {} at", "konto: {} und", "an {} erth"),
        "local_phone": ("call {} now", "phone: {} or", "reach {} by", "tel {}", "the {} of"),
    }
    short = ("password = {}", "pwd: {}", "passwort={} und", "password: {} .", "secret='{}'")
    grouped = ("call {} now", "Tel. {}", "tél : {} ou", "teléfono {} o", "Telefon {} und", "llame al {}", "appelez le {}", "phone: {} or", "mobil {}", "fax {} the")
    plain = (
        "order {n5} of the {n2} rows", "in {n4} there were {n3}", "version {n1}.{n1}.{n2} from {n4}-{n2}-{n2}", "pages {n3}-{n3} and {n4}", "on {n4}-{n2}-{n2} {n2} of",
        "the key {n2} to room {n3}", "a token of {n4} thanks", "item a{n5}b and x{n2}", "account no {n6}", "call {n2} people", "{n9} and {n10}", "{n3} {n3} {n3} {n2}",
        "total {n3},{n3}.{n2} for {n2}", "internationalization{n1} of words", "{n16} here", "{s7} of {s6}", "the key {s7}", "password of {s6}", "=== {s6} ===",
        "see /{s2}/{s3}/{s2}-{s3}-{s2}.html", "http://{s2}.com/{s3}/{n3}-{s2}-{s3}", "a {s2}-{s2}-{s2}-{s2} one", "----------------------", "{s5}={s5}", "{s4}_{s4}_{s4}", "{S7} and {S6}",
        "({n4}) {n2} ({n3}) {n1}", "{n2}.{n2}.{n4} and {n2}.{n2}.{n2}", "{n4} {n4} {n4}", "ISO {n4} {n5} A4 {n3}", "AB{n2} {s4} {n4} {n4}",
        "years {n4} {n4} {n4} {n4}", "0{n1} {n2} {n2} {n2} {n2} rows", "call {n3} {n2} times", "tel {n4} of {n4}", "sizes {n3} {n3} {n3} and {n2} {n2}", "0{n2} {n6} units", "{n3} {n2} {n2} {n2} points",
        "total: {n3} {n3} {n3}", "{n2}/{n2}/{n4} and {n4}/{n2}", "rooms {n2}-{n2}-{n2}", "password of the {s4}", "the token: a {s4} of {s3}",
    )

    def word(m: re.Match) -> str:
        kind, n = m[1], int(m[2])
        if kind == "n":
            return pick(num, n)
        w = "".join(r.choice(syllables) for _ in range(n))
        return w.capitalize() if kind == "S" else w

    out = []
    for _ in range(6):
        for kind, templates in with_entity.items():
            for t in templates:
                left, right = t.split("{}")
                value = made[kind]()
                out.append((left + value + right, [(len(left), len(left) + len(value), kind)]))
        for t in short:
            left, right = t.split("{}")
            value = pick(alnum, r.randint(4, 14)) if r.random() < 0.5 else pick(alnum, 1) + pick(alnum + "!#$%&*@(^-+.", r.randint(2, 28)) + pick(r.choice((alnum, alnum, "!)*$")), 1)
            out.append((left + value + right, [(len(left), len(left) + len(value), "secret")]))
        for t in grouped:
            left, right = t.split("{}")
            value = phone()
            out.append((left + value + right, [(len(left), len(left) + len(value), "local_phone")]))
        for _ in range(6):  # several on a line, some with nothing but a space between them
            line, spans = "", []
            for kind in r.sample(("secret", "ssn", "iban", "local_phone", "ssn", "local_phone"), r.randint(2, 3)):
                left, value = r.choice(("", "", "and ", "; ")), made[kind]()
                line += left
                spans.append((len(line), len(line) + len(value), kind))
                line += value + " "
            out.append((line, spans))
        out += [(re.sub(r"\{([nsS])(\d+)\}", word, t), []) for t in plain]
    return out


def likelihood(seqs: list[tuple[int, list[tuple[int, int]]]], rows: list[slice], gold: np.ndarray, moves: np.ndarray, x: np.ndarray, w: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Conditional log likelihood of the gold cuts and its gradients."""
    scores = x @ w
    value, expected, moved = float((scores * gold).sum() + (trans * moves).sum()), np.zeros_like(gold), np.zeros_like(trans)
    for (n, spans), at in zip(seqs, rows):
        total, p, m = forward_backward(n, spans, scores[at], trans)
        value -= total
        expected[at] = p
        moved += m
    return value, x.T @ (gold - expected), moves - moved


def problem(examples: list[tuple[str, list[tuple[int, int, str]]]]) -> tuple[list[str], tuple]:
    """The examples' regions as sequences: (names of the features, what likelihood needs apart from the weights)."""
    seqs, rows, names, index, gold, moves = [], [], {}, [], [], np.zeros((_KINDS, _KINDS))
    for text, spans in examples:
        want = {(a, b): ADDED.index(k) for a, b, k in spans}
        for a, b in regions(text, base_spans(text)):
            seq = sequence(text, a, b)
            if not seq.candidates:
                continue
            rows.append(slice(len(index), len(index) + len(seq.candidates)))
            seqs.append((len(seq.tokens), [c[:2] for c in seq.candidates]))
            at, before = 0, _OTHER
            for c in seq.candidates:
                index.append([names.setdefault(f, len(names)) for f in c[4]])
                kind = want.get(c[2:4])
                gold.append([float(kind == k) for k in range(_KINDS - 1)])
                if kind is not None:
                    for _ in range(c[0] - at):
                        moves[before, _OTHER] += 1
                        before = _OTHER
                    moves[before, kind + 1] += 1
                    at, before = c[1], kind + 1
            for _ in range(len(seq.tokens) - at + 1):  # the end counts as outside
                moves[before, _OTHER] += 1
                before = _OTHER
    x = np.zeros((len(index), len(names)))
    for i, f in enumerate(index):
        x[i, f] = 1.0
    return list(names), (seqs, rows, np.array(gold).reshape(-1, _KINDS - 1), moves, x)


@lru_cache(maxsize=1)
def trained(steps: int = 40, rate: float = 0.3, ridge: float = 0.02) -> Field:
    """Weights that maximise the penalised conditional likelihood of the examples' cuts, by steps scaled as in Adam."""
    names, data = problem(_examples())
    x = data[-1]
    theta = np.zeros((x.shape[1] + _KINDS, _KINDS))  # features by kinds (column 0 unused), then transitions
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, gw, gt = likelihood(*data, theta[: len(names), 1:], theta[len(names) :])
        g = np.zeros_like(theta)
        g[: len(names), 1:], g[len(names) :] = gw, gt
        g -= ridge * theta
        g[len(names), _OTHER] = 0.0  # staying outside weighs nothing, so text without candidates needs no reading
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Field(dict(zip(names, theta[: len(names), 1:])), theta[len(names) :])


def find_spans(text: str, model: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans); spans the field adds don't overlap the base's."""
    base = base_spans(text)
    added = [span for a, b in regions(text, base) for span in model.spans(text, a, b)]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base, spans) of every whole text; base and spans as kind:start:end.

    A null text is empty and holds nothing. Offsets count code points. Repeated rows give the same spans.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [find_spans(t, shared.value) for t in b.column(1).to_pylist()]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in BASE_KINDS]
            text = [pa.array([_joined(f[i]) for f in found], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, *text], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base", "spans"])

    kinds = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text")).mapInArrow(run, f"doc_id long, {kinds}, base string, spans string")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts of base spans, a digest of them and all spans of every document; null texts count as empty, repeated rows stay."""
    found = pii_spans(docs)
    return found.select("doc_id", *(f"n_{k}" for k in BASE_KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def mask(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by its kind in angle brackets, and n_chars (where there) counted anew.

    Null texts stay null; overlapping spans are replaced as one, by the first one's kind. All rows and other columns stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def masked(text: str | None) -> str | None:
        if text is None:
            return None
        parts, last = [], 0
        for a, b, kind in find_spans(text, shared.value)[1]:
            if b <= last:
                continue
            if a >= last:  # a span that overlaps the one before only lengthens it
                parts += [text[last:a], f"<{kind}>"]
            last = b
        return "".join([*parts, text[last:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            at = b.schema.get_field_index("text")
            yield b.set_column(at, b.schema.field(at), pa.array([masked(t) for t in b.column(at).to_pylist()], b.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
