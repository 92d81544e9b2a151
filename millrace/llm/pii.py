"""Personal data: base patterns plus candidates chosen by gradient boosting, in SQL functions only.

Base spans (email, ip, card, phone) are exact patterns and always stay. High-recall generators propose further spans, which may
overlap: emails written out ("at", "dot"), phone numbers without "+", IPv6 addresses (also with "::"), cards with odd separators,
long numbers, national and bank account numbers, and secrets (keys, tokens, passwords, by their form or by what they are assigned to).
Boosted trees score each by format and context; a kind's threshold is calibrated on held-out examples to a bounded share of false
alarms. No table labels personal data, so the trees are trained here, on made examples (N_TRAIN of them, fixed seed); they become one
expression. Generated spans that overlap a base span or a better one that is kept are dropped.

Work grows with the length of a text and its number of candidates: running sums and states go by chunks (common.scan), and spans
are compared within a run of overlapping ones only.
"""

from __future__ import annotations

import math
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone", "id", "secret")
MARK, MARK_FREE = chr(0xE000), chr(0xE001)  # private use; neither matches any pattern here
#: Every base ip, card or phone holds this; most texts do not.
NUMERIC = r"[0-9][0-9 ().+/-]{5,}[0-9]"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
IP_FITS = r"\A0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}\z"
#: A maximal run of digits, single blanks or dashes between them, of 12 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators: kind, what every match holds (texts without it are not searched), pattern. Quantifiers are bounded, so long texts cannot blow the matcher's stack.
GENERATORS = (
    ("email", r"(?i)[(\[{]at[)\]}]| at ", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[a-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]|\{dot\}| dot ) ?[a-z0-9-]{2,63}){1,4}"),
    ("phone", r"[0-9]{2}\)?[ ./-]{1,2}\(?[0-9]{2}", r"(?<![0-9A-Za-z+.,/(-])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])"),
    ("ip", r"[0-9A-Fa-f]:[0-9A-Fa-f]", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    ("ip", r"::[0-9A-Fa-f]|[0-9A-Fa-f]::", r"(?<![0-9A-Za-z:])(?=(?::{0,2}[0-9A-Fa-f]{1,4}){1,7}(?:::)?(?![0-9A-Za-z:]))(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z:])"),
    ("card", r"[0-9]{4}[._/][0-9]{4}", r"(?<![0-9A-Za-z.])[0-9]{4}(?:[._/][0-9]{4}){3}(?![0-9A-Za-z])"),
    ("id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    ("id", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("id", r"[0-9]{11}", r"(?<![0-9A-Za-z.,_-])[0-9]{11,24}(?![0-9A-Za-z_-]|[.,][0-9])"),
    ("secret", r"[0-9A-Fa-f]{24}", r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,128}(?![0-9A-Za-z])"),
    ("secret", r"AKIA|gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ", r"(?<![0-9A-Za-z_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,64}|sk-[0-9A-Za-z_-]{20,64}|xox[abprs]-[0-9A-Za-z-]{10,72}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{10,400}\.[0-9A-Za-z_-]{10,400}\.[0-9A-Za-z_-]{10,400})(?![0-9A-Za-z_-])"),
    ("secret", r"(?i)(?:token|secret|passw|pwd|key)[\x20\"'a-z0-9_-]{0,8}[:=]", r"(?i)(?<=(?:token|secret|password|passwd|pwd|key)[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?)(?![:=\x20\"'])[!#-&(-+.-:<-~]{6,128}"),
)
#: Context words, by kind, looked for in the CONTEXT characters before a candidate.
CONTEXT = 32
CUES = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "dial", "reach", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "id": ("ssn", "social", "iban", "account", "security", "passport"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "bearer", "credential"),
}
#: Words before hexadecimal digits that are no secret, and before numbers that name no person.
PUBLIC = ("commit", "sha", "md5", "checksum", "digest", "hash", "isbn", "issn", "time", "build", "revision", "total", "population")
FEATURES = ("kind", "length", "digits", "groups", "luhn", "cue", "at_marked", "dot_marked", "parens", "letters", "plain_date", "one_mark", "distinct", "upper", "public", "assigned", "leading")
N_TRAIN, N_HELD, N_TREES, DEPTH, RATE = 4000, 4000, 32, 4, 0.3
FALSE_ALARMS = 0.005


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Whether the digits of m pass the Luhn check."""
    d = F.reverse(_digits(m))
    digit = lambda i: F.substring(d, i, F.lit(1)).cast("int")
    twice = lambda i: F.when(digit(i) * 2 > 9, digit(i) * 2 - 9).otherwise(digit(i) * 2)
    total = F.aggregate(F.sequence(F.lit(1), F.char_length(d)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).otherwise(twice(i)))
    return (F.char_length(d) > 0) & (total % 10 == 0)


def _span(start: Column, end: Column, kind: int, m: Column, before: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(kind).alias("kind"), m.alias("m"), before.alias("before"))


FOUND = "array<struct<start:int,end:int,kind:int,m:string,before:string>>"


def _found(pieces: Column, kind: int) -> Column:
    """Spans of the odd pieces of a text that was split at marks, with the end of the piece before."""
    ends = common.scan(F.transform(pieces, F.char_length), F.lit(0), "int", lambda s, n: s + n)
    odd = F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2))
    return common.let(ends, lambda e: F.transform(odd, lambda i: _span(F.get(e, i - 1), F.get(e, i), kind, F.get(pieces, i), F.right(F.get(pieces, i - 1), F.lit(CONTEXT)))))


def _matches(d: DataFrame, t: str, p: str, name: str, gate: Column, pattern: str, kind: int) -> DataFrame:
    """d with the matches of pattern in t as spans; texts outside the gate are not searched. p: a free name."""
    marked = F.regexp_replace(F.col(t), F.lit(pattern), F.lit(f"{MARK}$0{MARK}"))
    d = d.withColumn(p, F.when(gate, F.split(marked, MARK, -1)))
    return d.withColumn(name, F.when(F.size(p) > 1, _found(F.col(p), kind)).otherwise(F.array().cast(FOUND))).drop(p)


def _emails(d: DataFrame, t: str, p_: str, name: str) -> DataFrame:
    """Emails between the @ of a text: the part before one and the part after it are the ends of neighbouring pieces."""
    local, domain = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\z", r"\A[A-Za-z0-9-][A-Za-z0-9.-]*+"
    d = d.withColumn(p_, F.when(F.contains(t, F.lit("@")), F.split(t, "@", -1)))

    def host(s: Column) -> Column:
        run = F.substring_index(F.regexp_extract(s, domain, 0), "..", 1)
        run = F.regexp_replace(run, r"\.\z", "")
        return F.when(F.contains(run, F.lit(".")), run).otherwise(F.lit(""))

    # the piece, its length, and those of its local part and of its host
    d = d.withColumn(p_, F.transform(p_, lambda s: common.let(host(s), lambda h: F.struct(s.alias("s"), F.char_length(s).alias("n"), F.char_length(F.regexp_extract(s, local, 0)).alias("local"), F.char_length(h).alias("host"), h.alias("name")))))
    d = d.withColumn(p_, F.zip_with(p_, F.slice(p_, F.lit(2), F.size(p_)), lambda x, y: F.struct(x.alias("x"), F.coalesce(y["host"], F.lit(0)).alias("next"), y["name"].alias("name"))))
    p = F.col(p_)
    ends = common.scan(F.transform(p, lambda q: q["x"]["n"] + 1), F.lit(0), "int", lambda s, n: s + n)
    # state: the first free place of the piece after a match, or -1; a match takes the host at the start of the next piece
    begin = lambda s, q: F.greatest(q["x"]["n"] - q["x"]["local"], F.when(s >= 0, s).otherwise(0))
    free = common.scan(p, F.lit(-1), "int", lambda s, q: F.when((q["next"] > 0) & (begin(s, q) < q["x"]["n"]), q["next"]).otherwise(F.lit(-1)))

    def spans(e: Column, f: Column) -> Column:
        hits = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.get(f, i) >= 0)

        def one(i: Column) -> Column:
            q, end = F.get(p, i), F.get(e, i) - 1
            at = begin(F.when(i > 0, F.get(f, i - 1)).otherwise(F.lit(-1)), q)
            m = F.concat(F.right(q["x"]["s"], q["x"]["n"] - at), F.lit("@"), q["name"])
            return _span(end - q["x"]["n"] + at, end + 1 + q["next"], 0, m, F.lit(""))

        return F.transform(hits, one)

    found = common.let(F.struct(ends.alias("e"), free.alias("f")), lambda x: spans(x["e"], x["f"]))
    return d.withColumn(name, F.when(F.size(p_) > 1, found).otherwise(F.array().cast(FOUND))).drop(p_)


def base_spans(d: DataFrame, t: str, names: list[str], free: str) -> DataFrame:
    """d with the names added: emails, ips, cards and phones in t, the text without marks, as arrays of spans. free: a free name."""
    email, ip, card, phone, p = *names, free
    num = F.col(t).rlike(NUMERIC)
    d = _emails(d, t, p, email)
    d = _matches(d, t, p, ip, num, IP, 1)
    d = _matches(d, t, p, card, num, CARD, 2)
    d = _matches(d, t, p, phone, num & F.contains(t, F.lit("+")), PHONE, 3)
    n = lambda x: F.char_length(_digits(x["m"]))
    return d.withColumns({
        ip: F.filter(ip, lambda x: x["m"].rlike(IP_FITS)),
        card: F.filter(card, lambda x: _luhn(x["m"])),
        phone: F.filter(phone, lambda x: (n(x) >= 9) & (n(x) <= 15)),
    })


# Candidates: features, alike in SQL and in Python.


def _features(c: Column, before: Column) -> Column:
    m, low = c["m"], F.lower(before)
    cue = F.lit(0)
    for k, words in CUES.items():
        cue = F.when((c["kind"] == KINDS.index(k)) & low.rlike(rf"(?<![a-z])(?:{'|'.join(words)})"), 1).otherwise(cue)
    return F.array(*[x.cast("double") for x in (
        c["kind"], F.char_length(m), F.char_length(_digits(m)), F.size(F.split(m, r"[^0-9A-Za-z]+")), F.when(_luhn(m), 1).otherwise(0), cue,
        F.when(m.rlike(r"(?i)[(\[{]at[)\]}]"), 1).otherwise(0), F.when(m.rlike(r"(?i)[(\[{]dot[)\]}]| dot "), 1).otherwise(0),
        F.when(F.contains(m, F.lit("(")), 1).otherwise(0), F.char_length(F.regexp_replace(m, r"[^A-Za-z]", "")),
        F.when(m.rlike(r"\A(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})\z"), 1).otherwise(0),
        F.size(F.array_distinct(F.split(F.regexp_replace(m, r"[0-9A-Za-z]+", ""), ""))),
        F.size(F.array_distinct(F.split(m, ""))), F.char_length(F.regexp_replace(m, r"[^A-Z]", "")),
        F.when(low.rlike(rf"(?<![a-z])(?:{'|'.join(PUBLIC)})"), 1).otherwise(0), F.when(before.rlike(r"[:=]\x20{0,2}[\"']?\z"), 1).otherwise(0),
        F.when(m.rlike(r"\A[0-9]{3}"), F.substring(m, 1, 3)).otherwise(F.lit("0")),
    )])


def features(kind: str, m: str, before: str) -> list[float]:
    digits = re.sub(r"[^0-9]", "", m)
    total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    marks = re.sub(r"[0-9A-Za-z]+", "", m)
    return [float(x) for x in (
        KINDS.index(kind), len(m), len(digits), len(re.split(r"[^0-9A-Za-z]+", m)), bool(digits) and total % 10 == 0,
        bool(re.search(rf"(?<![a-z])(?:{'|'.join(CUES[kind])})", before.lower())), bool(re.search(r"(?i)[(\[{]at[)\]}]", m)), bool(re.search(r"(?i)[(\[{]dot[)\]}]| dot ", m)),
        "(" in m, len(re.sub(r"[^A-Za-z]", "", m)), bool(re.fullmatch(r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}", m)),
        len(set(marks)) or 1,
        len(set(m)), len(re.sub(r"[^A-Z]", "", m)), bool(re.search(rf"(?<![a-z])(?:{'|'.join(PUBLIC)})", before.lower())), bool(re.search(r"[:=]\x20{0,2}[\"']?\Z", before)),
        int(m[:3]) if re.match(r"[0-9]{3}", m) else 0,
    )]


def _example(r: random.Random) -> tuple[str, str, str, int]:
    """A made candidate: kind, text, text before it, whether it is personal data."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    kind = r.choice(KINDS)
    good = r.random() < 0.5
    cue = r.random() < (0.6 if good else 0.05)
    before = f"{word()} {word()} {r.choice(CUES[kind]) + r.choice([': ', ' ', ' me on ']) if cue else word() + ' '}"
    if kind == "email":
        if good:
            o, c = r.choice(["()", "[]", "{}"])
            m = f"{word()}{r.choice(['.', '_', ''])}{word()}" + r.choice([f" {o}at{c} ", f"{o}at{c}"]) + word() + r.choice([f" {o}dot{c} ", f"{o}dot{c}", "."]) + r.choice(["com", "org", "net", "de", "fr"])
            if r.random() < 0.2:
                m = f"{word()} at {word()} dot {r.choice(['com', 'org', 'net'])}"
            if r.random() < 0.3:
                m = re.sub(r"\b(at|dot)\b", lambda x: x[0].upper(), m)
            if r.random() < 0.3:
                m = re.sub(r"[(\[{](at)[)\]}]", r" \1 ", m) if "dot" in m.lower() else m
        else:
            m = r.choice([f"{word()} at {word()}. {word()}", f"{word()} at {word()}.{word()}", f"{word()} at {word()} . {word()}", word() + " at " + ". ".join(word().title() for _ in range(r.randint(2, 5)))])
    elif kind == "phone":
        if good:
            s = r.choice([" ", "-", "."])
            m = r.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}{s}{n(3)}{s}{n(4)}", f"0{n(3)}{s}{n(3)}{s}{n(4)}", f"0{n(2)}{s}{n(4)}{s}{n(4)}", f"0{n(1)}{s}{n(2)}{s}{n(2)}{s}{n(2)}{s}{n(2)}"])
        else:
            m = r.choice([f"{n(2)}.{n(2)}.{n(4)}", f"{n(4)}-{n(2)}-{n(2)}", f"{n(4)}-{n(4)}", f"{n(2)} {n(3)}", f"{n(3)} {n(3)}", f"{n(3)}.{n(2)}", f"{n(5)}-{n(5)}-{n(5)}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(3)} {n(2)} {n(3)} {n(2)}", f"{n(4)} {n(4)} {n(4)} {n(4)}"])
    elif kind == "ip":
        m = ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8)) if good else ":".join(n(2) for _ in range(8))
        if r.random() < 0.5:  # with a run of zero groups left out; such as "face::add", "10::20" and "::2" are code
            h = lambda k: ":".join("".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(k))
            m = f"{r.choice(['2001', '2a02', '2606', 'fd00'])}:{h(r.randint(1, 3))}::{h(r.randint(0, 3))}" if r.random() < 0.6 else f"fe80::{h(r.randint(1, 4))}"
            if not good:
                w = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 4)))
                m = r.choice([f"{w()}::{w()}", f"{n(1)}::{n(1)}", f"{n(2)}::{n(2)}", f"::{n(1)}", f"{w()}::", f"::{w()}"])
    elif kind == "card":
        s = r.choice("._/")
        d = r.choice("3456") + n(14)
        check = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        d += str(-check % 10) if good else str((-check + r.randint(1, 9)) % 10)
        m = s.join(d[i : i + 4] for i in range(0, 16, 4))
    elif kind == "secret":
        pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
        hexes, mixed = "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
        named = r.choice(["token", "secret", "password", "api_key", "pwd", "access key"]) + r.choice([" = ", "=", ": "]) + r.choice(['"', "'", ""])
        if good:
            shape = r.random()
            m = pick(hexes, r.choice([32, 40, 64])) if shape < 0.5 else pick(mixed, r.randint(20, 48)) if shape < 0.75 else r.choice(["AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), "ghp_" + pick(mixed, 36), "sk-" + pick(mixed, 40)])
            m = m.upper() if r.random() < 0.1 else m
            if r.random() < 0.75:
                before = f"{word()} {named}"
                m = m if r.random() < 0.8 else word().title() + r.choice("!%*#") + n(r.randint(2, 5))
        elif r.random() < 0.5:
            m, before = pick(hexes, r.choice([24, 32, 40, 64])), f"{word()} {r.choice(PUBLIC[:6])} "
        else:
            m, before = r.choice([word() + word() + word()[:1], "required", "string", word().title() + word(), "0" * r.randint(24, 40), word() + "_" + word()]), f"{word()} {named}"
            if m[0] == "0":
                before = f"{word()} {word()} "
    elif r.random() < 0.5:
        m = n(r.choice([12, 14, 15, 16, 16, 16, 16, 17, 18, 19])) if good else r.choice(["1" + r.choice("4567") + n(11), r.choice(["978", "979"]) + n(10), r.choice("0123456789") * r.randint(11, 20), n(4) + "0" * r.randint(7, 12), n(11), n(24)])
        if not good and r.random() < 0.4:
            m, before = n(r.randint(11, 18)), f"{word()} {r.choice(PUBLIC[6:])} "
    else:
        m = r.choice([f"{n(3)}-{n(2)}-{n(4)}", r.choice(["DE", "FR", "GB", "ES"]) + n(2) + " " + " ".join(n(4) for _ in range(r.randint(4, 5)))])
        if not good:
            m = r.choice(["AB", "XK", "SN"]) + n(2) + "".join(r.choice("ABCDEFGH0123") for _ in range(12))
    return kind, m, before[-CONTEXT:], int(good)


@cache
def model() -> tuple[list, dict[str, float], float]:
    """Trees, threshold by kind, and accuracy on the held-out examples."""
    r = random.Random(11)
    rows = [_example(r) for _ in range(N_TRAIN + N_HELD)]
    x, y = np.array([features(*e[:3]) for e in rows]), np.array([e[3] for e in rows], float)
    kinds = np.array([e[0] for e in rows])
    score, trees = np.zeros(len(x)), []

    def grow(at: np.ndarray, depth: int) -> tuple | float:
        p = 1 / (1 + np.exp(-score[at]))
        g, h = y[at] - p, p * (1 - p)
        leaf = RATE * g.sum() / (h.sum() + 1)
        if not depth or len(at) < 20:
            return leaf
        best, base = (0.0, -1, 0.0), g.sum() ** 2 / (h.sum() + 1)
        for f in range(x.shape[1]):
            o = np.argsort(x[at, f], kind="stable")
            v, cg, ch = x[at[o], f], g[o].cumsum(), h[o].cumsum()
            for i in np.flatnonzero(v[1:] > v[:-1]).tolist():
                gain = cg[i] ** 2 / (ch[i] + 1) + (cg[-1] - cg[i]) ** 2 / (ch[-1] - ch[i] + 1) - base
                if gain > best[0] + 1e-9:
                    best = (gain, f, (v[i] + v[i + 1]) / 2)
        if best[1] < 0:
            return leaf
        left = x[at, best[1]] <= best[2]
        return best[1], best[2], grow(at[left], depth - 1), grow(at[~left], depth - 1)

    for _ in range(N_TREES):
        trees.append(grow(np.arange(N_TRAIN), DEPTH))
        score = np.array([sum(value(t, v) for t in trees[-1:]) for v in x]) + score
    held = np.arange(N_TRAIN, len(x))
    thresholds = {}
    for k in KINDS:
        bad = np.sort(score[held[(kinds[held] == k) & (y[held] == 0)]])
        upto = bad[math.ceil(len(bad) * (1 - FALSE_ALARMS)) - 1] if len(bad) else 0.0
        thresholds[k] = max(0.0, float(upto) + 1e-9)
    chosen = score[held] > np.array([thresholds[k] for k in kinds[held]])
    return trees, thresholds, float((chosen == (y[held] > 0)).mean())


def value(tree: tuple | float, v) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
    return tree


def _sql_value(tree: tuple | float, v: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(F.get(v, F.lit(tree[0])) <= tree[1], _sql_value(tree[2], v)).otherwise(_sql_value(tree[3], v))


def _apart(a: Column, b: Column) -> Column:
    return (a["end"] <= b["start"]) | (b["end"] <= a["start"])


def _chosen(scored: Column) -> Column:
    """Spans of scored (array of structs score, c; base spans have no score) that stay: the base, and of the others, best first, those
    that overlap none kept before; of equal scores the first span. Compared within runs of overlapping spans."""
    by_start = F.transform(F.array_sort(F.transform(scored, lambda x: F.struct(x["c"]["start"].alias("a"), x["c"]["end"].alias("z"), x["score"].alias("score"), x["c"].alias("c")))), lambda x: x)
    best = lambda run: F.array_sort(F.transform(run, lambda x: F.struct(F.coalesce(-x["score"], F.lit(float("-inf"))).alias("worse"), x["c"].alias("c"))))
    none = F.array().cast(FOUND)

    def greedy(run: Column) -> Column:
        is_base = lambda x: x["worse"] == float("-inf")
        keep = lambda kept, x: F.when(is_base(x) | F.forall(kept, lambda k: _apart(k, x["c"])), F.concat(kept, F.array(x["c"]))).otherwise(kept)
        return F.when(F.size(run) > 1, F.aggregate(best(run), none, keep)).otherwise(F.transform(run, lambda x: x["c"]))

    def runs(x: Column, reach: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["a"] >= F.get(reach, i - 1)))
        return common.let(heads, lambda h: F.flatten(F.transform(h, lambda i, k: greedy(F.slice(x, i + 1, F.coalesce(F.get(h, k + 1), F.size(x)) - i)))))

    chosen = common.let(by_start, lambda x: common.let(common.scan(F.transform(x, lambda s: s["z"]), F.lit(0), "int", lambda s, z: F.greatest(s, z)), lambda reach: runs(x, reach)))
    return F.when(F.size(scored) > 0, chosen).otherwise(none)


def find(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with base (array of base spans) and spans (base and added) added, ordered by start, then kind; start and end in code
    points, end exclusive; kind as index of KINDS.

    Null text counts as empty and has no spans. Texts of any length are searched whole, as one row. Columns of docs named like an added
    one are replaced, others may have any names; rows stand for themselves; an empty table stays empty.
    """
    names = common.fresh([*docs.columns, "base", "spans"], "t", "p", "email", "ip", "card", "phone", "all", *[f"g{i}" for i in range(len(GENERATORS))])
    t_, p_, four, all_, made = names[0], names[1], names[2:6], names[6], names[7:]
    d = docs.withColumn(t_, F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit(MARK_FREE)))
    d = base_spans(d, t_, four, p_)
    for name, (kind, gate, pattern) in zip(made, GENERATORS):
        d = _matches(d, t_, p_, name, F.col(t_).rlike(gate), pattern, KINDS.index(kind))
    trees, thresholds, _ = model()

    def score(x: Column) -> Column:
        total = F.lit(0.0)
        for tree in trees:
            total = total + _sql_value(tree, x)
        return total

    limits = F.array(*[F.lit(thresholds[k]) for k in KINDS])
    scored = F.transform(F.concat(*made), lambda c: common.let(_features(c, c["before"]), lambda f: F.struct(score(f).alias("score"), c.alias("c"))))
    scored = F.filter(scored, lambda x: x["score"] > F.get(limits, x["c"]["kind"]))
    base = F.transform(F.concat(*four), lambda c: F.struct(F.lit(None).cast("double").alias("score"), c.alias("c")))
    d = d.withColumn(all_, F.when(F.size(F.concat(*made)) > 0, F.concat(base, scored)).otherwise(base))
    order = lambda c: F.transform(F.array_sort(F.transform(c, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["m"].alias("m")))), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["m"].alias("m")))
    d = d.withColumn("base", order(F.concat(*four))).withColumn("spans", order(_chosen(F.col(all_))))
    return d.drop(*names)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in angle brackets; overlapping spans become one replacement, of the first's kind. Null
    text stays null."""
    kinds = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    reach = common.scan(F.transform(spans, lambda s: s["end"]), F.lit(0), "int", lambda a, z: F.greatest(a, z))

    def pieces(upto: Column) -> Column:
        done = lambda i: F.coalesce(F.get(upto, i - 1), F.lit(0))
        one = lambda s, i: F.when(s["start"] >= done(i), F.concat(F.substring(text, done(i) + 1, s["start"] - done(i)), F.get(kinds, s["kind"]))).otherwise(F.lit(""))
        rest = F.substring(text, F.element_at(upto, -1) + 1, F.char_length(text))
        return F.concat(F.array_join(F.transform(spans, one), ""), rest)

    return F.when(F.size(spans) > 0, common.let(reach, pieces)).otherwise(text)
