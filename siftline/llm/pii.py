"""Personal data and secrets: base patterns, and candidates that boosted trees choose from.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. High-recall generators
then propose overlapping spans: addresses with a spelled-out at sign, national phone numbers,
grouped or bare digit runs, account and identity numbers; and as secrets what is assigned to a name
like password or token, long runs of letters and digits, keys of known beginnings, and private key
blocks. Numbers may stand beside each other: a run
of digits, blanks and signs, of any length, is proposed whole and in every part, from one group of
digits to another, that has the digits and at most the groups (NUMBERS) of a kind. Boosted trees
score each from its format and its context; the scores are calibrated on held-out examples, and each
kind's threshold is the least probability that reached the wanted precision there. Accepted spans
that overlap no base span are added, the likelier first where they overlap each other.

There are no labelled spans, so the trees are trained on examples made from a seed: well-formed and
broken values of each kind in fitting and in unfitting contexts. Context words count as whole words
or, from four letters on, as beginnings of words. Null or empty texts have no spans.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .boosted import BoostedTrees, calibrate, threshold_for
from .storage import ship

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
_TRIGGER = re.compile(r"[0-9@=]|\(at\)|\[at\]|-----BEGIN|(?<=[A-Za-z\"'\x20]):")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans, by kind and start."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:  # a match's local part is all of its characters before the sign, back to the last match
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at) if begin < at else None
        if m:
            out.append(("email", begin, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1) if begin == at else last
        at = text.find("@", max(at + 1, last))
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return out


_RUN = re.compile(r"[0-9][0-9\x20().\-/]{5,}[0-9]")
_GROUP = re.compile(r"[0-9]+")
_NATIONAL = re.compile(r"(?=((?:\([0-9]{3}\)|[0-9]{3})[\x20.-][0-9]{3}[\x20.-][0-9]{4})(?![0-9]))")
#: For each kind the least and most digits, and the most groups of digits that its written forms have.
NUMBERS = {"phone": (7, 15, 7), "card": (13, 19, 5), "ssn": (9, 9, 3)}
#: Groupings of payment cards by digits: all but the last group of four, or these.
CARD_GROUPS = ([4, 6, 5], [4, 6, 4])
#: Groupings of national phone numbers, without and with a leading 0.
PHONE_GROUPS = ([3, 3, 4], [1, 3, 3, 4], [3, 4], [7], [8], [9], [10], [11])
TRUNK_GROUPS = ([2, 2, 2, 2, 2], [3, 4, 4], [5, 6])
BLOCK = 4096
#: Lengths are those that addresses and account numbers can have: 64 before the sign, 63 a label, 34 in all.
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|@)\x20?[A-Za-z0-9-]{1,63}(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\.)[A-Za-z0-9-]{1,63})+")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{2,4}){3,8}(?![A-Za-z0-9])")
_ASSIGNED = re.compile(r"[:=]\x20*[\"']?([^\s\"'<>,;]{6,})")
_LONG = re.compile(r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{20,}")
_BLOCK_KEY = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]*-----END [A-Z ]*PRIVATE KEY-----)?")
#: Names that secrets are assigned to, and how issued keys begin.
NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "secret_key", "private_key", "auth_key")
ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk-", "sk_live_", "xoxb-", "xoxp-", "AIza", "hf_", "npm_")
#: Words beside digests and numbers that are no secrets.
DIGESTS = ("sha", "md5", "commit", "checksum", "hash", "digest", "uuid", "etag", "revision", "build", "file")
#: Fixed context words of each kind, and words that speak against personal data.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach"),
    "ip": ("ip", "host", "address", "login"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security", "tax"),
    "secret": ("key", "secret", "token", "password", "credential", "auth", "login"),
}
AGAINST_OF = {"secret": DIGESTS}
_WORD = re.compile(r"[a-z]+[0-9]*")
AGAINST = ("order", "invoice", "version", "isbn", "ref", "token", "password", "page", "total", "price")


def _numbers(text: str, run: re.Match) -> Iterator[tuple[str, int, int]]:
    """Every part of a run, from group to group of digits, that can be a number of some kind; the whole run has any number of groups."""
    groups = [g.span() for g in _GROUP.finditer(text, *run.span())]
    for i, (begin, _) in enumerate(groups):
        digits = 0
        for j in range(i, len(groups)):
            end = groups[j][1]
            digits += end - groups[j][0]
            if digits > 19:
                break
            whole = i == 0 and j == len(groups) - 1
            fits = [k for k, (least, most, parts) in NUMBERS.items() if least <= digits <= most and (whole or j - i < parts)]
            if fits:  # an opening parenthesis belongs to the number if it is closed within
                start = begin - (text[begin - 1 : begin] == "(" and ")" in text[begin:end])
                yield from ((k, start, end) for k in fits)


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text or "at" in text:
        yield from (("email", *m.span()) for m in _SPELLED.finditer(text))
    for run in _RUN.finditer(text):
        yield from _numbers(text, run)
        yield from (("phone", *m.span(1)) for m in _NATIONAL.finditer(text, max(0, run.start() - 1), run.end()))
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            if text[max(0, m.start() - 20) : m.start()].rstrip(" \"'").lower().endswith(NAMES):
                yield ("secret", *m.span(1))
    for m in _LONG.finditer(text):
        yield ("secret", *m.span())
    if "-----BEGIN" in text:
        yield from (("secret", *m.span()) for m in _BLOCK_KEY.finditer(text))
    for m in _ACCOUNT.finditer(text):
        yield ("iban", *m.span())
        # what follows the account number can look like more of its blocks
        for gap in re.finditer(r"\x20", m.group()):
            if _ACCOUNT.fullmatch(text, m.start(), m.start() + gap.start()):
                yield ("iban", m.start(), m.start() + gap.start())


def candidates(text: str) -> list[tuple[str, int, int]]:
    """High-recall proposals, overlapping and of several kinds."""
    return sorted(set(_proposals(text)))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = [len(g) for g in re.findall(r"[0-9]+", span)] or [0]
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 16].lower()
    near, lead = _WORD.findall(before + " " + after), _WORD.findall(before)
    said = lambda words, names: any(w == x or len(x) > 3 and w.startswith(x) for w in words for x in names)
    shown = span[:200]
    secret = kind == "secret"
    letters = span.replace(" ", "")
    moved = letters[4:] + letters[:4]
    mod97 = kind == "iban" and moved.isalnum() and moved.isascii() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    edge = lambda c: 0.0 if c == "" or c.isspace() else 1.0 if c.isalnum() else 2.0
    return [
        *(float(kind == k) for k in KINDS),
        len(span),
        len(digits),
        sum(c.isalpha() for c in span),
        sum(c in " -./" for c in span),
        len(groups),
        groups[0],
        groups[-1],
        max(groups),
        float(groups in ([3, 3, 4], [1, 3, 3, 4])),
        float(groups == [3, 2, 4] and span.count("-") == 2),
        float("(" in span),
        float(bool(digits) and luhn(digits)),
        float(mod97),
        len(set(digits)),
        edge(text[start - 1 : start]),
        edge(text[end : end + 1]),
        float(said(near, CONTEXT[kind])),
        float(said(lead, AGAINST_OF.get(kind, AGAINST)) or (not secret and ("no." in before or "#" in before))),
        float(re.search(r"(?:at\)|at\]|@)", span) is not None),
        float("=" in before[-2:] or "#" in before[-2:] or "$" in before[-2:]),
        float(digits[:1] == "0"),
        float(kind == "phone" and (groups in PHONE_GROUPS or digits[:1] == "0" and groups in TRUNK_GROUPS)),
        float(kind == "card" and (set(groups[:-1]) <= {4} or groups in CARD_GROUPS)),
        float(kind == "card" and (digits[0] in "3456" or "2221" <= digits[:4] <= "2720")),
        float(secret and before.rstrip(" :=\"'").endswith(NAMES) and re.search(r"[:=]\x20*[\"']?$", before) is not None),
        float(secret and span.startswith(ISSUED)),
        float(secret and span.startswith("-----BEGIN")),
        float(secret and said(lead, DIGESTS)),
        float(secret and all(c in "0123456789abcdef" for c in shown)),
        float(secret and re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", shown) is not None),
        float(secret) * len(set(shown)) / max(1, len(shown)),
        float(secret) * sum(a.isdigit() != b.isdigit() for a, b in zip(shown, shown[1:])) / max(1, len(shown)),
        float(secret) * sum(c.isupper() for c in shown) / max(1, len(shown)),
        float(secret) * sum(c in "-_" for c in shown) / max(1, len(shown)),
    ]


def training_examples(seed: int = 7, per_kind: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of made examples; half of each kind are personal data."""
    rng = np.random.default_rng(seed)
    filler = ["the", "of", "and", "in", "sent", "from", "said", "to", "von", "la", "with", "was"]
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    number = lambda n: "".join(str(d) for d in rng.integers(0, 10, n))

    def card(good: bool) -> str:
        sizes = pick([[4, 4, 4, 4]] * 3 + [[4, 6, 5]])
        faults = () if good else pick([("check",), ("check",), ("issuer",), ("groups",), ("check", "issuer"), ("check", "groups"), ("issuer", "groups"), ("check", "issuer", "groups")])
        body = pick("0178" if "issuer" in faults else "3" if sizes[1] == 6 else "3456") + number(sum(sizes) - 2)
        ends = [str(d) for d in range(10) if luhn(body + str(d)) != ("check" in faults)]
        x = body + pick(ends)
        if "groups" in faults:
            sizes = pick([[4, 12], [2, 4, 4, 4, 2], [8, 8], [3, 2, 4, 3, 4], [4, 11], [3, 5, 4, 4], [2] * 8])
        cuts = np.cumsum([0, *sizes])
        return x if "groups" not in faults and rng.random() < 0.5 else pick(" -").join(x[a:b] for a, b in zip(cuts, cuts[1:]) if x[a:b])

    def iban(good: bool) -> str:
        land, body = pick(["DE", "FR", "ES", "NL"]), number(pick([11, 14, 18, 18, 20, 23]))
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        x = f"{land}{(check if good else (check + 7) % 97):02d}{body}"
        return x if rng.random() < 0.5 else " ".join(x[i : i + 4] for i in range(0, len(x), 4))

    def drawn(signs: str, n: int) -> str:
        return "".join(signs[int(i)] for i in rng.integers(0, len(signs), n))

    def secret(good: bool) -> tuple[str, str, str]:
        """What stands before a secret, or before what only looks like one, the value, and what follows."""
        low, hexes, mixed = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
        upper = mixed[:26] + "0123456789"
        name, sign, mark = pick(NAMES), pick(["=", "=", ":", " = ", ": "]), pick(["", "", '"', "'"])
        word = lambda: drawn(low, int(rng.integers(4, 11)))
        if good:
            kind = int(rng.integers(0, 5))
            if kind == 0:
                return "", pick(["AKIA", "ASIA"]) + drawn(upper, 16), ""
            if kind == 1:
                return "", pick(ISSUED[2:]) + drawn(mixed, int(rng.integers(24, 41))), ""
            if kind == 2:
                return pick(["", f"{name}{sign}"]), "-----BEGIN " + pick(["", "RSA ", "EC "]) + "PRIVATE KEY-----", ""
            value = pick([drawn(hexes, int(rng.integers(12, 65))), drawn(mixed, int(rng.integers(10, 41))), drawn(mixed + "!$%&*+-.@_", int(rng.integers(8, 25))), word() + number(int(rng.integers(2, 5)))])
            return f"{name}{sign}{mark}", value, mark
        kind = int(rng.integers(0, 6))
        if kind == 0:
            return f"{pick(DIGESTS)}{pick([' ', ': ', '256 ', '='])}", drawn(hexes, int(rng.choice([32, 40, 64]))), ""
        if kind == 1:
            return pick(["", "id ", "uuid "]), "-".join(drawn(hexes, n) for n in (8, 4, 4, 4, 12)), ""
        if kind == 2:
            return "", "-".join([word(), word(), word(), number(int(rng.integers(1, 5)))]) + word(), ""
        if kind == 3:
            return f"{name}{sign}", pick(["required", "optional", "string", "unknown", "missing", "(none)", word() + "ing"]), ""
        if kind == 4:
            return "", "_".join([word(), word(), number(2), word()]) + word(), ""
        return "", number(int(rng.integers(20, 40))), ""

    def value(kind: str, good: bool, within: bool) -> str | tuple[str, str, str]:
        # a sound number together with one beside it, as candidates of a run have it
        sound = pick([f"{number(3)}-{number(2)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}"])
        straddling = [f"{number(2)} {sound}", f"{sound} {number(4)}", f"{sound[4:]} {number(3)}-{number(2)}", f"{number(2)} {sound[:7]}"]
        if kind == "email":
            name, host = pick(["ann", "bob.lee", "j_doe", "info"]), pick(["mail", "corp", "uni"])
            return pick([f"{name} (at) {host}.org", f"{name}[at]{host}[dot]com", f"{name}(at){host}.net"]) if good else pick([f"{name}@{host}.x", f"5 @ {number(1)}.{number(2)}", f"a @ {number(2)}.{number(1)}"])
        if kind == "phone":
            a, b, c = number(3), number(3), number(4)
            pair, year = lambda: f"{int(rng.integers(10, 100))}", lambda: f"{int(rng.integers(1900, 2100))}"
            abroad = [f"0{number(1)} {number(2)} {number(2)} {number(2)} {number(2)}", f"0{number(2)} {number(4)} {number(4)}", f"0{number(4)} {number(6)}", f"1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"{b}-{c}", f"{b}-{c}", f"{b} {c}", f"{number(4)}-{c}", f"{a}{b}{c}", f"{b}{c}", number(8), number(9)]
            table = [" ".join(pair() for _ in range(int(rng.integers(4, 7)))), " ".join(year() for _ in range(int(rng.integers(2, 4)))), f"{year()}-{pair()}-{pair()}", f"{pair()}/{pair()}/{year()}", f"0{number(1)}-{pair()} {year()}-0{number(1)}", f"0{number(1)} {year()}-{pair()}-0{number(1)}", f"0{number(2)} {number(4)}", f"0{number(1)} {number(2)} {number(2)} {number(2)}"]
            if good:
                return pick([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"] * 2 + abroad)
            return pick(table + straddling) if within else pick([number(8), f"{number(4)}-{number(2)}-{number(2)}", f"{number(2)}/{number(2)}/{number(4)}", f"{number(3)}.{number(5)}", f"{number(1)} {number(1)} {number(1)} {number(1)} {number(1)} {number(1)} {number(1)}", number(16)[:15], *table, *straddling])
        if kind == "card":
            return card(good)
        if kind == "iban":
            return iban(good) if good or rng.random() < 0.5 else f"{iban(True)} {number(4)}"
        if kind == "secret":
            return secret(good)
        if kind == "ssn":
            return pick([f"{number(3)}-{number(2)}-{number(4)}"] * 3 + [number(9)]) if good else pick([number(9), f"{number(3)} {number(3)} {number(3)}", f"{number(4)}-{number(5)}", f"{number(3)} {number(3)}-{number(3)}", f"{number(2)}-{number(4)} {number(3)}"])
        return f"{number(2)}.{number(2)}.{number(2)}.{number(1)}"

    rows, labels, kinds = [], [], []
    for kind in ("email", "phone", "card", "iban", "ssn", "secret"):
        for i in range(2 * per_kind * (1 + 2 * (kind == "phone"))):
            good, helped = i % 2 == 0, rng.random() < 0.8
            # a broken value never counts; a sound one in a context that speaks against it doesn't either
            hostile = rng.random() < (0.15 if good else 0.4)
            # parts of runs of numbers stand in fitting contexts too
            within = not hostile and helped and (good or (kind in ("phone", "card", "iban") and rng.random() < 0.5))
            lead = [pick(filler) for _ in range(3)] + ([pick(AGAINST)] if hostile else [pick(CONTEXT[kind])] if within else [])
            # other numbers can stand beside it
            prefix, body = " ".join(lead) + " " + pick(["", "", "", f"{number(4)} ", f"{number(2)} / ", f"{number(3)}-{number(2)}-{number(4)}, "]), value(kind, good, within)
            if kind == "secret":
                hostile = False
                prefix, (opening, body, closing) = " ".join(lead[:3]) + " ", body
                prefix += opening
            else:
                closing = ""
            text = prefix + body + closing + pick([" ", " ", " ", f" {number(4)} ", f" / {number(2)} ", f". {number(1)} "]) + pick(filler)
            rows.append(features(text, kind, len(prefix), len(prefix) + len(body)))
            labels.append(float(good and not hostile and (helped or kind in ("card", "iban", "secret"))))
            kinds.append(KINDS.index(kind))
    return np.array(rows), np.array(labels), np.array(kinds)


class _Taken:
    """Spans, merged where they overlap; whether another is free of them is found by bisection."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda x: x[1]):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def free(self, span: tuple[str, int, int]) -> bool:
        i = bisect_left(self.starts, span[2])
        return i == 0 or self.ends[i - 1] <= span[1]

    def add(self, span: tuple[str, int, int]) -> None:
        """Only for a span that is free."""
        i = bisect_left(self.starts, span[1])
        self.starts.insert(i, span[1])
        self.ends.insert(i, span[2])


class SpanModel:
    """Boosted trees, their calibration, and a threshold for each kind."""

    def __init__(self, precision: float = 0.98, seed: int = 7):
        x, y, kind = training_examples(seed)
        held = np.arange(len(y)) % 4 >= 2
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        score = self.trees.score(x[held])
        self.slope, self.shift = calibrate(score, y[held])
        p = self._probability(score)
        self.threshold = {k: max(0.5, threshold_for(p[kind[held] == i], y[held][kind[held] == i], precision)) if (kind[held] == i).any() else 1.01 for i, k in enumerate(KINDS)}
        passed = np.array([p[i] >= self.threshold[KINDS[kind[held][i]]] for i in range(len(p))])
        self.held_out = {"precision": float(y[held][passed].mean()), "recall": float(passed[y[held] > 0].mean())}

    def _probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * score + self.shift)))

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Accepted candidates that overlap neither a base span nor a likelier candidate (to a hundredth; then the longer)."""
        taken = _Taken(base)
        found = [c for c in candidates(text) if taken.free(c)]
        passed: list[tuple[float, tuple[str, int, int]]] = []
        for at in range(0, len(found), BLOCK):
            some = found[at : at + BLOCK]
            p = self._probability(self.trees.score(np.array([features(text, *c) for c in some])))
            passed += [(-x, c) for x, c in zip(p.tolist(), some) if x >= self.threshold[c[0]]]
        out: list[tuple[str, int, int]] = []
        for _, c in sorted(passed, key=lambda x: (round(x[0], 2), x[1][1] - x[1][2])):
            if taken.free(c):
                taken.add(c)
                out.append(c)
        return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SpanModel | None = None, with_text: bool = False) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base, spans[, redacted]) for every row of docs.

    The counts and base are of base spans; spans also has what the model added. Both are joined as
    kind:start:end by kind, then start.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or SpanModel())
    counts = ("email", "ip", "card", "phone")
    schema = f"{id_col} long, " + ", ".join(f"n_{k} long" for k in counts) + ", base string, spans string" + ", redacted string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _ in textkit.row_blocks(batches):
            numbers, base, spans, texts = {k: [] for k in counts}, [], [], []
            for text in block.column("text").to_pylist():
                text = text or ""
                own = base_spans(text) if _TRIGGER.search(text) else []
                more = own + shared.value.added(text, own) if _TRIGGER.search(text) else own
                for k in counts:
                    numbers[k].append(sum(x[0] == k for x in own))
                base.append(joined(own))
                spans.append(joined(more))
                if with_text:
                    texts.append(redact(text, more))
            out = [block.column("id"), *(pa.array(numbers[k], pa.int64()) for k in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())]
            names = [id_col, *(f"n_{k}" for k in counts), "base", "spans"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(texts, pa.string())] * with_text, names=names + ["redacted"] * with_text)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)




def redact_documents(docs: DataFrame, text_col: str = "text", model: SpanModel | None = None) -> DataFrame:
    """docs, all columns, with every span in text_col replaced by its kind in brackets; null texts stay null."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or SpanModel())

    def clean(text: str | None) -> str | None:
        if not text or not _TRIGGER.search(text):
            return text
        own = base_spans(text)
        return redact(text, own + shared.value.added(text, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _, _ in textkit.row_blocks(batches, text_col):
            at = block.schema.get_field_index(text_col)
            yield block.set_column(at, block.schema.field(at), pa.array([clean(x) for x in block.column(at).to_pylist()], block.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
