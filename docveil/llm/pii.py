"""Personal data by weak supervision.

Base spans (e-mail addresses, IPv4 addresses, payment cards, international phones) are found by fixed patterns and checks and always
stay.  Beyond them, looser candidates are judged: disguised addresses, IPv6, numbers of accounts, identity documents and local phones,
access keys, names, street addresses and dates of birth.  Labelers that look at a candidate's shape, at gazetteers (issuers, dialling codes,
top-level domains, key prefixes, given names, kinds of street) and at its context vote for, against or abstain.  How often each
combination of votes occurs is counted over all documents; expectation-maximisation over these counts estimates each labeler's
reliability by kind and each combination's probability; a logistic span classifier is fitted to those probabilities on features of the span.
Of candidates that overlap, the one that the classifier holds most probable stays, and is added from ``threshold`` on if at least two
labelers vote for it.  Numbers of 16 to 19 digits that fail the card check stay out.

The combinations of votes and features are a small fixed set (``_space`` of them at most), so their counts come to the driver whatever
the number of documents.

Defined results: a null or empty text has no span; offsets are code points with exclusive ends; added spans overlap neither the base
nor each other, and of equally probable ones the longer, then the earlier, then the kind listed first stays; repeated rows need no care,
as rows are judged alone; an empty table gives no rows and trains nothing.
"""

from __future__ import annotations

import ipaddress
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored

KINDS = ("email", "ip", "card", "phone", "id", "account", "key", "name", "address", "birth")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match from within a run of digits has the same end as one from its start, so only starts are tried: linear on long runs
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Gazetteers: leading digits of issuers, dialling codes, common top-level domains, prefixes of access keys, given names, kinds of street.
_ISSUER = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65", "35", "36", "30", "38")
_DIALLING = ("00", "0", "1", "33", "34", "44", "49", "555")
_TLD = frozenset("com org net edu gov io de fr es uk eu info biz".split())
_ISSUED = ("ghp_", "gho_", "sk-", "sk_", "pk_", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "eyJ", "glpat-", "ya29")
_GIVEN = frozenset("""Aaron Adam Alan Alba Albert Alejandro Alice Alicia Amy Andrea Andreas Andrew Anna Anne Antoine Antonio Arthur Barbara Beatriz Ben Benjamin Bernd
Brian Camille Carla Carlos Carmen Catherine Charles Charlotte Chloe Christian Christine Claire Claudia Cristina Daniel David Deborah Diana Diego Dieter Donald Edward Elena
Elisabeth Elizabeth Emily Emma Enrique Eric Esther Eva Fernando Francisco Frank George Grace Hannah Hans Heinrich Helen Helga Henry Ines Irene Isabel Ivan Jack Jacques James
Javier Jean Jennifer Jessica Joachim John Jonas Jorge Jose Joseph Juan Julia Julie Karen Karl Katharina Kevin Klaus Laura Lea Linda Lisa Louis Lucas Lucia Luis Manuel Margaret
Maria Marie Mario Mark Marta Martin Mary Matthew Maximilian Mercedes Michael Miguel Monika Nancy Nathalie Nicolas Nicole Olivia Oscar Pablo Patricia Patrick Paul Paula Pedro
Peter Philip Pierre Pilar Rachel Rafael Ramon Raquel Rebecca Renate Richard Robert Roberto Rosa Ruth Sabine Samuel Sandra Sara Sarah Sergio Silvia Simon Sofia Sophie Stefan
Stephen Steven Susan Sylvie Teresa Thomas Ursula Valerie Victor Victoria Walter Werner William Wolfgang Xavier Yolanda Yves""".split())
_ROAD = "Street|St|Road|Rd|Avenue|Ave|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Square|Way"
_VIA = "Calle|Avenida|Avda|Plaza|Paseo|Camino|Rue|Avenue|Boulevard|Chemin|Impasse|Allée"
_CAPITAL = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+"
# candidates beyond the base patterns
_LOOSE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]{2,64}\x20?[(\[{](?:at|@)[)\]}]\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[{](?:dot|\.)[)\]}]\x20?)[A-Za-z0-9-]{1,63})+"),
    "ip": re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?![0-9A-Za-z:])"),
    "card": re.compile(r"(?<![0-9A-Za-z+.-])[0-9]{4}(?:[\x20-][0-9]{4}){2}[\x20-][0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.-])[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5}(?![0-9A-Za-z])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20./-]\(?[0-9]{2,4}\)?[\x20./-][0-9]{2,4}(?:[\x20./-][0-9]{2,4})?(?![0-9A-Za-z])"),
    "id": re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z]|[XYZ]-?[0-9]{7}-?[A-Z])(?![0-9A-Za-z-])"),
    "account": re.compile(r"(?<![0-9A-Za-z+.,:/_-])(?:[0-9]{12,19}|[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![0-9A-Za-z_/-])"),
    "key": re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=-]{20,}+(?:\.[A-Za-z0-9+/_=-]{12,}+){0,2}+(?![A-Za-z0-9+/_=-])"),
    "name": re.compile(rf"(?<!\w){_CAPITAL}(?:\x20[A-Z]\.)?(?:\x20{_CAPITAL}){{1,2}}(?!\w)"),
    "address": re.compile(rf"(?<!\w)(?:[0-9]{{1,5}}\x20(?:{_CAPITAL}\x20){{1,3}}(?:{_ROAD})(?!\w)|(?:{_VIA})\x20(?:de\x20|del\x20|la\x20|du\x20|des\x20){{0,2}}{_CAPITAL}(?:\x20{_CAPITAL}){{0,2}},?\x20[0-9]{{1,4}}(?!\w)|[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|allee)\x20[0-9]{{1,4}}(?!\w))"),
    "birth": re.compile(r"(?<![0-9A-Za-z./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9A-Za-z/-])"),
}
_AFTER = r"\W{0,3}(?:\w+\W{1,3}){0,3}\Z"
_FOR = {
    kind: re.compile(f"(?:{words}){_AFTER}", re.I)
    for kind, words in {
        "email": r"e-?mail|mail|contact|write|correo|courriel|kontakt",
        "ip": r"\bip|address|host|server|client|adresse|dirección",
        "card": r"card|credit|visa|mastercard|amex|payment|tarjeta|carte|karte",
        "phone": r"phone|tel|telephone|call|mobile|cell|fax|dial|whatsapp|teléfono|móvil|téléphone|telefon|anruf",
        "id": r"\bssn|social security|tax id|national id|identity|\bdni|\bnie|ausweis|passport|pasaporte",
        "account": r"account|iban|\bacct|card|cuenta|compte|konto|tarjeta|carte|karte|policy|member",
        "key": r"token|secret|password|passwd|\bpwd|api[ _-]?key|access[ _-]?key|bearer|credential|authorization|contraseña|passwort|clave",
        "name": r"\bmr|\bmrs|\bms|\bdr|name is|named|called|signed|dear|regards|sincerely|\bby|author|señora?|don|doña|monsieur|madame|herrn?|frau",
        "address": r"address|lives?|located|street|dirección|domicilio|adresse|wohnhaft|habite",
        "birth": r"born|birth|\bdob|nacid[oa]|nacimiento|née?|naissance|geboren|geburtsdatum",
    }.items()
}
_AGAINST = re.compile(r"(?:[$€£#§]|\b(?:isbn|issn|version|page|order|invoice|item|ticket|no|nr|figure|table|chapter|year|doi|sku|ref|commit|sha(?:1|256)?|md5|checksum|hash|uuid|build|tracking))\W{0,3}\Z", re.I)
_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"

LABELERS = ("shape", "gazetteer", "context", "against", "check")
_space = len(KINDS) * 3 ** len(LABELERS) * 3


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = []
    at = 0
    p = text.find("@")
    while p >= 0:
        # leftmost match: from the start of the run before "@", but not before the last match's end
        s = p
        while s > at and text[s - 1] in _LOCAL:
            s -= 1
        if s < p and (m := _DOMAIN.match(text, p + 1)):
            out.append(("email", s, m.end()))
            at = m.end()
            p = text.find("@", at)
        else:
            at = p + 1
            p = text.find("@", p + 1)
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(d := x.lstrip("0")) <= 3 and int(d or 0) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _mod97(value: str) -> bool:
    v = value.replace(" ", "")
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _id_check(value: str) -> int:
    v = value.replace("-", "")
    if v[-1].isalpha():
        number = "XYZ".find(v[0])
        return 1 if _DNI[int((str(number) + v[1:-1]) if number >= 0 else v[:-1]) % 23] == v[-1] else -1
    return -1 if v[:3] in ("000", "666") or v[0] == "9" or v[3:5] == "00" or v[5:] == "0000" else 1


def _address6(value: str) -> int:
    try:
        return 1 if isinstance(ipaddress.ip_address(value), ipaddress.IPv6Address) else -1
    except ValueError:
        return -1


def _shape_gazetteer_check(kind: str, value: str) -> tuple[int, int, int]:
    digits = _digits(value)
    if kind == "email":
        return 1, 1 if re.split(r"[^A-Za-z]+", value.lower().rstrip(")]}"))[-1] in _TLD else -1, 0
    if kind == "ip":
        return 1 if value.count(":") == 7 or "::" in value else -1, 1 if value[:1] in "23fF" else 0, _address6(value)
    if kind == "card":
        return 1, 1 if digits.startswith(_ISSUER) else -1, 1 if luhn(digits) else -1
    if kind == "phone":
        plain = re.fullmatch(r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}|[0-9]{4}[./-][0-9]{2}[./-][0-9]{2}|[0-9]{3}-[0-9]{2}-[0-9]{4}", value)
        return 1 if 9 <= len(digits) <= 12 and len(set(re.findall(r"[\x20./-]", value))) <= 2 else -1, 1 if digits.startswith(_DIALLING) else 0, -1 if plain else 0
    if kind == "id":
        return 1, 0, _id_check(value)
    if kind == "account":
        if value[0].isalpha():
            return 1, 0, 1 if _mod97(value) else -1
        # instants are written in 13 or 14 digits; numbers that count up or repeat are examples; from 16 digits on these are cards that failed
        instant = len(digits) in (13, 14) and digits[:2] in ("14", "15", "16", "17", "18", "19", "20")
        steps = {(int(y) - int(x)) % 10 for x, y in zip(digits, digits[1:], strict=False)}
        issued = len(digits) in (14, 15) and digits.startswith(_ISSUER) and luhn(digits)
        return -1 if instant else 0, 1 if issued else 0, -1 if len(digits) >= 16 or len(steps) < 3 or len(set(digits)) < 4 else 0
    if kind == "key":
        hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
        mixed = sum(map(bool, (re.search(c, value) for c in ("[a-z]", "[A-Z]", "[0-9]")))) >= (2 if hexadecimal else 3)
        return 1 if mixed and len(value) <= 256 and "/" not in value[:1] else -1, 1 if value.startswith(_ISSUED) else 0, 1 if len(set(value)) >= min(12, len(value) // 2) and len(digits) >= 4 else -1
    if kind == "name":
        return 1, 1 if value.split()[0] in _GIVEN else -1, 0
    if kind == "address":
        return 1, 1, 0
    parts = [int(x) for x in re.split(r"[./-]", value)]
    day, month, year = parts[::-1] if parts[0] > 31 else parts
    return 1, 0, 1 if 1 <= min(day, month) <= 12 and max(day, month) <= 31 and 1900 <= year else -1


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 abstains."""
    shape, gazetteer, check = _shape_gazetteer_check(kind, text[start:end])
    before = text[max(0, start - 40) : start]
    return shape, gazetteer, 1 if _FOR[kind].search(before) else 0, -1 if _AGAINST.search(before[-12:]) else 0, check


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pattern) of spans beyond the base; the pattern spells kind, votes and size.

    They don't overlap the base, nor others of their kind.
    """
    out: list[tuple[str, int, int, str]] = []
    digit, bracket = bool(_DIGIT.search(text)), "(" in text or "[" in text or "{" in text
    taken = sorted((s, e) for _, s, e in base)
    for kind, loose in _LOOSE.items():
        if not (bracket if kind == "email" else kind == "name" or digit):
            continue
        reach, b = -1, 0
        for m in loose.finditer(text):
            s, e = m.span()
            while b < len(taken) and taken[b][0] < e:
                reach = max(reach, taken[b][1])
                b += 1
            if s < reach or (kind == "key" and not _DIGIT.search(m[0])) or (kind == "name" and m[0].split()[0] not in _GIVEN) or (kind == "birth" and not _FOR[kind].search(text[max(0, s - 40) : s])):
                continue  # two words in capitals, and dates, are mostly something else
            size = min(2, len(_digits(m[0])) // 8)
            out.append((kind, s, e, f"{KINDS.index(kind)}{size}" + "".join("-0+"[v + 1] for v in votes(kind, text, s, e))))
    return out


def chosen(found: list[tuple[str, int, int, str]], probability: dict[str, float], threshold: float) -> list[tuple[str, int, int, str]]:
    """The candidates of at least this probability, the more probable ones (then the longer, the earlier, the kind listed first) instead of those they overlap."""
    out: list[tuple[str, int, int, str]] = []
    good = [c for c in found if probability.get(c[3], 0) >= threshold]
    good.sort(key=lambda c: (c[1], c[2]))
    at = 0
    while at < len(good):  # one island of overlapping spans after the other
        end, to = good[at][2], at + 1
        while to < len(good) and good[to][1] < end:
            end, to = max(end, good[to][2]), to + 1
        island = sorted(good[at:to], key=lambda c: (-probability[c[3]], c[1] - c[2], c[1], KINDS.index(c[0])))
        kept: list[tuple[str, int, int, str]] = []
        for c in island:
            if all(c[2] <= k[1] or k[2] <= c[1] for k in kept):
                kept.append(c)
        out += kept
        at = to
    return sorted(out, key=lambda c: (KINDS.index(c[0]), c[1]))


def _decoded(pattern: str) -> tuple[int, int, np.ndarray]:
    return int(pattern[0]), int(pattern[1]), np.array(["-0+".index(c) - 1 for c in pattern[2:]])


def fit(counts: dict[str, int], rounds: int = 50, prior: float = 0.3) -> dict[str, float]:
    """The final classifier's probability of each pattern.

    Expectation-maximisation over a two-class model in which labelers vote independently given the class, with the counts as weights,
    Beta-like pseudo-counts and a bound that say a vote is right more often than not; then logistic regression to its probabilities.
    """
    if not counts:
        return {}
    names = sorted(counts)
    dec = [_decoded(p) for p in names]
    kind, v = np.array([d[0] for d in dec]), np.array([d[2] for d in dec])
    n = np.array([counts[p] for p in names], float)
    n_l = len(LABELERS)
    # P(vote | class) over votes -1, 0, 1; pseudo-counts make votes informative before any data
    pseudo = np.array([[4.0, 6.0, 1.0], [1.0, 6.0, 4.0]])
    q = np.zeros(len(names))
    for own in (np.flatnonzero(kind == k) for k in np.unique(kind)):  # a labeler is as reliable as it is for a kind
        n_k, v_k = n[own], v[own]
        like = np.repeat((pseudo / pseudo.sum(1, keepdims=True))[:, None], n_l, 1)
        pi = prior
        for _ in range(rounds):
            logs = np.log([1 - pi, pi])[:, None] + np.stack([sum(np.log(like[c, j, v_k[:, j] + 1]) for j in range(n_l)) for c in range(2)])
            q_k = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
            for c, w in enumerate((1 - q_k, q_k)):
                for j in range(n_l):
                    like[c, j] = pseudo[c] + [(n_k * w)[v_k[:, j] == k].sum() for k in (-1, 0, 1)]
                like[c] /= like[c].sum(1, keepdims=True)
            # labelers are better than chance: a vote for is never evidence against, nor the other way round
            for k, wrong in ((2, like[1, :, 2] < like[0, :, 2]), (0, like[1, :, 0] > like[0, :, 0])):
                like[:, wrong, k] = like[:, wrong, k].mean(0)
            pi = float(np.clip((n_k * q_k).sum() / n_k.sum(), 0.02, 0.8))
        q[own] = q_k
    x = np.concatenate([v, np.eye(len(KINDS))[[d[0] for d in dec]], np.eye(3)[[d[1] for d in dec]], np.ones((len(names), 1))], 1).astype(float)
    w = np.zeros(x.shape[1])
    weight = n / n.sum()
    for _ in range(30):  # Newton steps, ridge 1e-3
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (p - q)) + 1e-3 * w)
    return dict(zip(names, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def agreed(pattern: str) -> bool:
    """Whether two labelers or more vote for a candidate; the word of one alone, such as a shape, is never enough."""
    return pattern.count("+") >= 2


_FOUND = "array<struct<kind:string,start:int,end:int,base:boolean,pattern:string>>"
_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("pattern", pa.string())]))


def _span(kind: str, start: int, end: int, pattern: str | None = None) -> dict:
    return {"kind": kind, "start": start, "end": end, "base": pattern is None, "pattern": pattern}


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): base spans and candidates of every row."""

    def scan(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in b["text"].to_pylist():
            base = base_spans(t)
            rows.append([_span(*x) for x in base] + [_span(*x) for x in candidates(t, base)])
        return pa.record_batch([b["doc_id"], pa.array(rows, _KIND)], names=["doc_id", "found"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return map_batches(rows, scan, f"doc_id {docs.schema[id_col].dataType.simpleString()}, found {_FOUND}")


def detect_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, spans) for every row: spans of (kind, start, end, base, pattern) by kind as listed, then start."""
    found = stored(scanned(docs, id_col, text_col), "personal-data")
    counts = found.select(F.explode("found").alias("f")).where("not f.base").groupBy("f.pattern").count().limit(_space).collect()
    probability = {p: x for p, x in fit({r["pattern"]: r["count"] for r in counts}).items() if x >= threshold and agreed(p)}

    def choose(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for spans in b["found"].to_pylist():
            base = [(x["kind"], x["start"], x["end"]) for x in spans if x["base"]]
            more = chosen([(x["kind"], x["start"], x["end"], x["pattern"]) for x in spans if not x["base"]], probability, threshold)
            rows.append([_span(*x) for x in sorted([*base, *more], key=lambda x: (KINDS.index(x[0]), x[1]))])
        return pa.record_batch([b["doc_id"], pa.array(rows, _KIND)], names=["doc_id", "spans"])

    return map_batches(found, choose, f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans {_FOUND}")
