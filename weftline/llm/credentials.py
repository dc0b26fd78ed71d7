"""Credentials written out in source, configuration and prose.

Quoted strings and long tokens are taken out of the text together with what stands
around them. Each is held against the Shannon entropy that a random string of its
length over its alphabet would have. How much of that it must reach depends on its
place: nearly all of it where nothing else speaks for a secret, less where a name, a
header, a URL's user information or a login says that a secret stands there. Hashes,
identifiers, references and placeholders are left out.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?!-----BEGIN).){40,}?-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)

# Name parts that say a secret follows, in several languages.
_STRONG = {
    "password", "passwd", "pwd", "pass", "passphrase", "passcode", "pw", "secret", "secrets", "token", "apikey", "credential", "credentials", "cred", "creds",
    "passwort", "kennwort", "geheimnis", "contrasena", "contraseña", "clave", "mdp", "motdepasse", "senha", "jeton", "auth", "authorization", "bearer",
    "heslo", "haslo", "hasło", "wachtwoord", "parola", "parole", "losenord", "lösenord", "salasana", "jelszo", "adgangskode", "schluessel", "schlüssel",
    "authtoken", "accesstoken", "secretkey", "accesskey", "privatekey", "webhooksecret", "clientsecret",
}
_KEYS = {"key", "cle", "clé", "clave", "llave"}
_KEY_OF = {"api", "secret", "access", "private", "signing", "sign", "encryption", "encrypt", "auth", "master", "service", "account", "hmac", "jwt", "session", "deploy", "license", "licence", "storage", "client", "app", "cookie"}
_PHRASES = ("mot_de_passe", "mot de passe", "cle_api", "clef_api", "clave_api", "clave_secreta", "api_schluessel", "pass_phrase")
_ENDS = ("password", "passwd", "secretkey", "secret", "apikey", "accesskey", "heslo", "haslo", "hasło", "wachtwoord", "parola", "parole", "losenord", "lösenord", "salasana", "jelszo", "adgangskode",
    "authtoken", "accesstoken", "passphrase", "privatekey")
# Name parts that say something else follows.
_OTHER = {
    "ref", "refs", "file", "path", "dir", "re", "regex", "pattern", "url", "uri", "name", "field", "header", "prompt", "hint", "label", "help", "type", "env", "var", "len", "length", "count", "limit", "ttl", "expiry", "policy", "provider", "backend", "class",
    "public", "pub", "checksum", "sha", "sha1", "sha256", "sha512", "md5", "digest", "hash", "commit", "revision", "rev", "uuid", "guid", "id", "integrity", "etag", "fingerprint", "version", "endpoint", "column", "table",
}
_ENDINGS = {"table", "field", "column", "count", "limit", "id", "name", "type", "label", "class"}
_HASHES = {"checksum", "sha", "sha1", "sha256", "sha512", "sha384", "md5", "digest", "hash", "commit", "revision", "rev", "uuid", "guid", "integrity", "etag", "fingerprint", "public", "pub", "crc", "blob", "icon", "image", "img", "data", "payload", "signature", "sig", "build", "ref", "sum"}

_PLACEHOLDER = re.compile(
    r"x{4,}|\*{3,}|\.{3,}|-{5,}|_{4,}|#{3,}|0{6,}|1{6,}|redacted|changeme|change[-_ ]me|replace[-_ ]?(?:me|with)|your[-_ ]|placeholder|not[-_ ]?a[-_ ]?secret|notreal|not[-_ ]real|"
    r"foobar|test[-_ ]?(?:key|token|secret|password|pass)|deadbeef|123456|abcdef|qwerty|hidden[-_ ]?value|<[^>]*>|letmein|geheim123|s3cr3t|hunter2|"
    # words that a random value may hold by chance: as a word of their own only
    r"(?<![A-Za-z0-9])(?:example|dummy|sample|todo|fixme|insert|fake|lorem|masked|removed|none|null|undefined|here)(?![A-Za-z0-9])",
    re.I,
)
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|%\(|%[A-Z_]+%|^\$|^@|^<|^\{|\}$|^(?:vault|secret|secrets|ssm|env|file|arn|kms|op|aws|gcp|azure|projects|ref)[:/]|^(?:process|os|env|config|settings|self|this)\.|\)$|^/|^\.\.?/|^https?:", re.I)
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_IDENTIFIER = re.compile(r"[a-z]+(?:[_.\-/:][a-z0-9]+)*|[A-Z]+(?:_[A-Z0-9]+)*|[a-z]+(?:[A-Z][a-z]+)+\d{0,2}|(?:[A-Z][a-z]+){1,}\d{0,2}|[a-z]+(?:_[a-z]+)*_\d+")
_CAPITALS = re.compile(r"[A-Z0-9]{16,40}")
_DOTTED = re.compile(r"[\w$]+(?:\.[A-Za-z_$][\w$]*)+=?")
_PADDED = re.compile(r"(?:[A-Za-z0-9+/]{4})+(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)")
_SENTENCE = re.compile(r"\s")

_NAME = r"[A-Za-zÀ-ÿ_$][\wÀ-ÿ$.\-]*"
#: name = value, name: value, "name": "value", name => value, name := value; with what may stand between.
_NAMED = re.compile(
    rf"(?P<q>[\"'`]?)(?P<name>{_NAME}(?: {_NAME}){{0,3}}?)(?P=q)\]?[ \t]*(?:\?[ \t]*)?(?:\|\|=|\?\?=|:[ \t]*(?:str|String|string|bytes)[ \t]*=|:=|=>|==|=|:)[ \t]*(?:\|[-+]?[ \t]*\r?\n[ \t]*)?(?P<pre>(?:[uUbBrRfF]{{1,2}}(?=[\"'`])|new \w+\(|Buffer\.from\(|(?:str|bytes|String|SecretStr)\()?)"
    r"(?:(?P<s>\"\"\"|'''|[\"'`])(?P<quoted>[^\"'`\n]{4,}?)(?P=s)|(?P<bare>[^\s\"'`,;(){}\[\]<>]{6,}))"
)
_URL_USER = re.compile(r"[a-zA-Z][a-zA-Z0-9+.\-]{1,20}://[^\s:/@\"'`]{0,80}:(?P<value>[^\s@\"'`/]{3,})@")
_SCHEME = re.compile(r"(?i)\b(?P<scheme>basic|bearer|token|apikey|digest)(?:[ \t]+|[=:][ \t]*)[\"'`]?(?P<value>[A-Za-z0-9+/=_.~\-]{8,})")
_QUERY = re.compile(r"(?i)[?&](?P<name>[a-z_\-]*(?:key|token|secret|password|passwd|pwd|sig|signature|auth|pass))=(?P<value>[^\s&\"'`#<>]{6,})")
_HEADER = re.compile(r"(?i)\b(?P<name>[a-z\-]*(?:api-?key|token|secret|password|auth)[a-z\-]*)[\"'`]?[ \t]*:[ \t]*[\"'`]?(?P<value>[A-Za-z0-9+/=_.~\-]{8,})")
_USER_PASS = re.compile(r"(?:(?<!\S)-u|--user|--userpwd|--login)[ =][\"'`]?[^\s:\"'`]{1,80}:(?P<value>[^\s\"'`]{4,})")
_OPTION = re.compile(r"(?i)(?<![\w\-])--?(?P<name>[a-z][a-z\-_]{1,40})[\"'`]?(?:[ =][\"'`]?|,[ \t]*[\"'`])(?P<value>[^\s\"'`,\]=]{6,}={0,2})(?![\w(])")
_HMAC = re.compile(r"(?i)hmac(?:\.new)?\([ \t]*(?:[\"'`]sha\d+[\"'`][ \t]*,[ \t]*)?[bB]?(?P<t>[\"'`])(?P<value>[^\"'`\n]{6,})(?P=t)")
_CALL = re.compile(r"(?P<name>[\w.]+)\([ \t]*[uUbB]?(?P<s>[\"'`])[^\"'`\n]{1,80}(?P=s)[ \t]*,[ \t]*[uUbB]?(?P<t>[\"'`])(?P<value>[^\"'`\n]{6,})(?P=t)")
#: Prose that hands a login on: a verb, whose login it is, and the value.
_LOGIN = re.compile(r"(?i)\b(?:login|log in|logs in|logged in|sign in|signs in|signed in|rotate me|before changing)\b[^\n\"'`]{0,60}?(?:[ \t](?:is|was|with|/|->|=>|=|:|\|)[ \t]+|: ?|/ |(?<=changing) )[\"'`]?(?P<value>[^\s\"'`<>,;]{6,})")
#: Prose that says what a secret is or was.
_TOLD = re.compile(r"(?i)(?<![\w\-])(?P<name>[\w\-]{2,60}(?: [\w\-]{2,20})?)(?:[ \t]+(?:as|from|of|on|for)[ \t]+[\w\-]+)?[ \t]+(?:is|was|->|=>|for [\w\-]+:)[ \t]+[\"'`]?(?P<value>[^\s\"'`<>,;]{6,})")
_FOR = re.compile(r"(?i)\b(?P<name>token|password|passwort|secret|api[ _-]?key|key|credentials?)[ \t]+(?:for|of)[ \t]+[\w\-]+:?[ \t]+[\"'`]?(?P<value>[^\s\"'`<>,;]{6,})")
#: A comment, line or last sentence of prose that is nothing but user:value.
_COLON = re.compile(r"(?m)(?:^[ \t]*(?:#+|//+|;+|>|\*|--)?[ \t]*|[.!?][ \t]+)[A-Za-z][\w.\-]{2,40}:(?P<value>[^\s\"'`<>,;:]{8,})[ \t]*$")
_FLAG = re.compile(r"[\"'`]-p[\"'`][ \t]*,[ \t]*(?P<t>[\"'`])(?P<value>[^\"'`\s]{6,})(?P=t)")
_DEFAULT = re.compile(r"(?:environ\.get|getenv|env)\([ \t]*[\"'](?P<name>\w+)[\"'][ \t]*,[ \t]*(?P<t>[\"'])(?P<value>[0-9a-fA-F]{32,})(?P=t)")
_ARGUMENT = re.compile(r"\([ \t]*(?P<s>[\"'`])--?(?P<name>[\w\-]+)(?P=s)[^()\n]{0,80}?\bdefault[ \t]*=[ \t]*(?P<t>[\"'`])(?P<value>[^\"'`\n]{6,})(?P=t)")
_PUT = re.compile(r"\([ \t]*(?P<s>[\"'`])(?P<name>[\w\-.]{3,80})(?P=s)[ \t]*,[ \t]*[uUbB]?(?P<t>[\"'`])(?P<value>[^\"'`\n]{6,})(?P=t)")
_PAIR = re.compile(r"(?i)[\w\-]*(?:login|auth|credentials?|user|account)s?[\"'`]?[ \t]*[:=][ \t]*\{[ \t]*[\"'`][^\"'`\n]{1,60}[\"'`][ \t]*:[ \t]*(?P<t>[\"'`])(?P<value>[^\"'`\n]{6,})(?P=t)[ \t]*\}")
_ACCESS = re.compile(r"(?i)\b(?:zugang|zugangsdaten|acc[eè]s|acceso|accesso|inloggen|anmeldung|connexion)\b[^\n\"'`]{0,60}?(?:[ \t](?:mit|avec|con|met|:)[ \t]+|: )[\"'`]?(?P<value>[^\s\"'`<>,;]{6,})")
_COMPARE = re.compile(r"(?:===?|!==?|compare_digest\([^,\n]+,|\bequals\()[ \t]*[uUbB]?(?P<s>[\"'`])(?P<value>[^\"'`\s]{8,})(?P=s)")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_\-.~%])[A-Za-z0-9][A-Za-z0-9+/_\-.]{15,}={0,2}(?![A-Za-z0-9+/_\-])")
_JWT = re.compile(r"eyJ[\w\-]{8,}\.eyJ[\w\-]{8,}\.[\w\-]{8,}")
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----(?:(?!-----BEGIN).)*?-----END [A-Z0-9 ]+-----", re.S)
_LEAD = re.compile(r"(?i)(?:basic|bearer|token|apikey)[ \t]+")
_GRANTS = re.compile(r"(?i)grant|allow|unlock|admin|auth|login|enter|ok\b|true")
_HASH_BEFORE = re.compile(r"(?i)sha-?\d*[ \"':=\-]|md5|checksum|digest|integrity|commit|revision|\brev\b|uuid|etag|fingerprint|base64,|public[ _-]?key|ssh-(?:rsa|ed25519)|_(?:sha|sig)\b")
#: Lines of a body of data.
_DATA_LINE = re.compile(r"(?m)^[ \t\"'b(]*[A-Za-z0-9+/=]{56,}[\"',+ \\)]*$")


def entropy(value: str) -> float:
    """Shannon entropy in bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def alphabet(value: str) -> int:
    """Size of the alphabet that the value seems to be drawn from."""
    if _HEX.fullmatch(value):
        return 16
    size = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value)
    return max(2, size + len({c for c in value if not c.isalnum()}))


def randomness(value: str) -> float:
    """Entropy of the value as a part of what a random string of its length and alphabet would have on average."""
    n, size = len(value), alphabet(value)
    if n < 2:
        return 0.0
    # the mean entropy of a sample falls short of log2(size) by about (size - 1) / (2 n ln 2); few samples reach log2(n)
    expected = min(math.log2(size) - min((size - 1) / (2 * n * math.log(2)), 0.4 * math.log2(size)), math.log2(n) * 0.94)
    return entropy(value) / max(expected, 0.5)


def changes(value: str) -> float:
    """How often neighbours are of different kinds (lower, upper, digit, other); words seldom, random strings often."""
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "o" for c in value]
    return sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, len(value) - 1)


def name_parts(name: str) -> list[str]:
    return [p for p in re.split(r"[^a-zà-ÿ0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()) if p]


def names_secret(name: str) -> int:
    """2 if the name says that its value is a secret, 1 if it may be, 0 if not, -1 if it says it's something else."""
    parts = name_parts(name)
    if not parts:
        return 0
    plain = "_".join(parts)
    last = parts[-1] if not parts[-1].isdigit() else parts[-2] if len(parts) > 1 else ""
    strong = any(p in _STRONG or p.endswith(_ENDS) for p in parts)
    if last in _HASHES:
        return -1
    if last in _OTHER:
        # a name of many parts may end in any word; one of two says what it holds
        return (2 if last in _ENDINGS else 1) if strong and len(parts) > 2 else -1
    if any(p in plain for p in ("_".join(x.split()) for x in _PHRASES)):
        return 2
    if last in _STRONG or last.endswith(_ENDS) or (len(parts) > 1 and parts[-2] in _STRONG and len(last) <= 3):
        return 2
    if last in _KEYS and (len(parts) > 1 and parts[-2] in _KEY_OF):
        return 2
    if strong or any(a in _KEY_OF and b in _KEYS for a, b in zip(parts, parts[1:], strict=False)):
        return 2
    if last in _KEYS or last in ("dsn", "session", "cookie", "jwt", "login", "user"):
        return 1
    return -1 if any(p in _HASHES for p in parts) else 0


def dummy(value: str) -> bool:
    """Blanked, obviously made up, or a reference to where the value is kept."""
    if _REFERENCE.search(value) or _PLACEHOLDER.search(value):
        return True
    letters = Counter(value)
    return len(letters) < 5 or letters.most_common(1)[0][1] > 0.5 * len(value)


def plausible(value: str, trust: int) -> bool:
    """Whether the value is a secret. ``trust``: 3 if its place is a secret's, 2 if it says so, 1 if it may be, 0 if nothing does."""
    if len(value) < (5 if trust == 3 else 6) or _SENTENCE.search(value) or dummy(value):
        return False
    if _UUID.fullmatch(value) or value.startswith("__") and value.endswith("__"):
        return False
    if trust < 3 and any(c in "{}()\\|" for c in value):
        return False
    if trust == 3:
        return value.lower() not in _STRONG and value.lower() not in ("user", "username", "admin")
    mixed = any(c.isdigit() for c in value) + any(c.isupper() for c in value) + any(c.islower() for c in value) + any(not c.isalnum() for c in value)
    if _HEX.fullmatch(value) and len(value) >= 16:
        return trust == 2 and randomness(value) > 0.8
    if _IDENTIFIER.fullmatch(value) and trust < 3 and not (trust == 2 and value[-1].isdigit() and len(value) >= 8):
        return False
    if trust == 2:
        if re.fullmatch(r"[\d.,:+\-]+", value):
            return False
        return mixed >= 2 and randomness(value) > 0.55 and len(value) >= 8
    if trust == 1:
        return mixed >= 3 and len(value) >= 10 and randomness(value) > 0.75 and changes(value) > 0.15 and not _DOTTED.fullmatch(value)
    core = max(re.split(r"[^A-Za-z0-9]+", value), key=len)
    if len(core) < 10 or sum(c.isdigit() for c in core) < 1 or changes(core) < (0.15 if mixed == 2 else 0.3) or value.endswith("=") and not _PADDED.fullmatch(value):
        return False
    if mixed == 2 and not (_CAPITALS.fullmatch(value) and sum(c.isdigit() for c in value) > 1):
        return False
    return mixed >= 2 and len(value) >= 16 and any(c.isdigit() for c in value) and randomness(value) > 0.84 and value.count("/") <= 1 + len(value) // 16 and value.count(".") <= 2


def _trim(value: str) -> str:
    return value.strip().rstrip(".,;:)")


# Pieces of text without which no rule but that for long tokens applies.
_TRIGGERS = (
    "pass", "pwd", "pw", "secret", "token", "key", "cle", "clé", "clave", "kennwort", "contrase", "senha", "heslo", "haslo", "hasło", "wachtwoord", "parol", "senord", "lösenord", "salasana", "jelszo", "adgangskode", "jeton", "geheim", "llave", "schl",
    "auth", "login", "log in", "logs in", "logged in", "sign in", "signs in", "signed in", "cred", "bearer", "basic", "://", "-u ", "--user", "dsn", "mdp", "zugang", "acces", "accès", "inloggen", "anmeldung", "connexion", "connect", "rotate me", "before changing", "== '", '== "', "compare_digest", "'-p'", '"-p"', "environ", "getenv", "hmac", "jwt", "cookie", "session",
)
_LONGISH = re.compile(r"(?<![A-Za-z0-9+/_\-.~%])(?=[A-Za-z+/_\-.]*\d)[A-Za-z0-9][A-Za-z0-9+/_\-.]{15,}")
_TWO = re.compile(r"\((?P<s>[\"'])[^\"'\n]{1,60}(?P=s), ?[\"'](?=[^\"'\n]*\d)[^\"'\n ]{8,}[\"']\)")
_LONELY = re.compile(r"(?m)(?:^[ \t]*(?:#+|//+|;+|>|\*|--)?[ \t]*|[.!?][ \t]+)[A-Za-z][\w.\-]{2,40}:[^\s\"'`<>,;:]{8,}[ \t]*$")


#: Where a window on a long line may end: no value goes on beyond a quote or a line end.
_EDGE = re.compile(r"[\"'`\n]")
#: Characters of the longest run of letters and digits that the rules are run on as it stands.
LONG_RUN = 2000
_RUN = re.compile(rf"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{{{LONG_RUN + 1},}}")


@functools.lru_cache(maxsize=1)
def _triggers():  # noqa: ANN202
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word in _TRIGGERS:
        machine.add_word(word, len(word))
    machine.make_automaton()
    return machine


def _edge(text: str, at: int) -> int:
    """The end of the token or string that stands at the place."""
    m = _EDGE.search(text, at)
    return m.end() if m else len(text)


def _shortened(text: str) -> tuple[str, list[int], list[int]]:
    """The text with the middle of its longest runs left out, which no rule looks into, where that was, and the characters left out up to there."""
    parts, places, left_out = [], [], []
    at = length = gone = 0
    for m in _RUN.finditer(text) if len(text) > LONG_RUN and max(map(len, text.split("\n"))) > LONG_RUN else ():
        low, high = m.start() + LONG_RUN // 2, m.end() - LONG_RUN // 2
        parts.append(text[at:low])
        length, gone, at = length + low - at, gone + high - low, high
        places.append(length)
        left_out.append(gone)
    return "".join([*parts, text[at:]]) if parts else text, places, left_out


def _segments(text: str, before: int = 240, after: int = 480) -> list[tuple[int, int]]:
    """Stretches of the text that may hold a secret: whole lines around triggers, of very long lines a part that cuts no token or string."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change their number of characters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    places = [end for end, _ in _triggers().iter(low)]
    places += [m.start() for m in _LONGISH.finditer(text)]
    if "(" in text:
        places += [m.start() for m in _TWO.finditer(text)]
    if ":" in text:
        places += [m.start() for m in _LONELY.finditer(text)]
    places.sort()
    out: list[tuple[int, int]] = []
    for p in places:
        if out and p < out[-1][1]:
            if out[-1][1] >= p + after or text[out[-1][1] - 1 : out[-1][1]] == "\n":
                continue
        start = max(text.rfind("\n", max(0, p - 4 * before), p) + 1, p - before)
        end = text.find("\n", p, p + after)
        end = _edge(text, p + after) if end < 0 else end + 1
        if text[max(0, end - 4) : end].rstrip().endswith(("|", "|-", ":")):  # a block of YAML goes on
            more = text.find("\n", end, end + after)
            end = _edge(text, end + after) if more < 0 else more + 1
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def secrets(text: str) -> list[tuple[int, int]]:
    """Spans of the credentials in the text, in order, none within another."""
    spans: list[tuple[int, int]] = []
    pems: list[tuple[int, int]] = []
    if "-----BEGIN" in text:
        spans += [m.span() for m in _PEM.finditer(text) if not _blank_key(m.group())]
        pems = [m.span() for m in _BLOCK.finditer(text)]
    whole = text
    text, places, left_out = _shortened(whole)
    segments = _segments(text)
    if not segments:
        return _outermost(spans)
    data = [m.span() for m in _DATA_LINE.finditer(whole)]
    crowd = len(data) >= 4
    hash_lines: dict[int, bool] = {}

    def line_says_hash(at: int) -> bool:
        start = max(whole.rfind("\n", 0, at) + 1, at - 200)
        if start not in hash_lines:
            hash_lines[start] = bool(_HASH_BEFORE.search(whole, start, at))
        return hash_lines[start]

    def place(at: int) -> int:
        """The place in the whole text."""
        k = bisect.bisect_left(places, at)
        return at + left_out[k - 1] if k else at

    def add(m: re.Match, trust: int, group: str | int = "value", skip: int = 0) -> None:
        start, end = m.span(group)
        start, end = place(start + skip), place(end)
        value = whole[start:end]
        stripped = _trim(value)
        if len(stripped) < 5:
            return
        start += value.find(stripped)
        end = start + len(stripped)
        if trust < 2 and line_says_hash(start):
            return
        if any(a <= start < b for a, b in pems) or crowd and any(a <= start < b for a, b in data):
            return
        if plausible(stripped, trust):
            spans.append((start, end))

    for low, high in segments:
        found = list(_NAMED.finditer(text, low, high))
        for m in found:
            says = names_secret(m["name"])
            if says == -1:
                continue
            group = "quoted" if m["quoted"] else "bare"
            value = m[group]
            if group == "quoted" and says == 0 and ("=" in value or ":" in value):
                found += _NAMED.finditer(text, *m.span(group))  # a name and a value within the string
            if group == "bare" and text[m.end() : m.end() + 1] in ("(", "["):
                continue
            lead = _LEAD.match(value)
            if says == 2 or lead:
                add(m, 2, group, lead.end() if lead else 0)
            elif group == "quoted":
                add(m, 2 if says == 1 and len(value) in (32, 40, 48, 64, 128) and _HEX.fullmatch(value) and name_parts(m["name"])[-1] in _KEYS else says, group)
        part = text[low:high].lower()
        if "://" in part:
            for m in _URL_USER.finditer(text, low, high):
                add(m, 3)
            for m in _QUERY.finditer(text, low, high):
                add(m, 2)
        if "-" in part:
            for m in _USER_PASS.finditer(text, low, high):
                add(m, 3)
            for m in _OPTION.finditer(text, low, high):
                if names_secret(m["name"]) == 2:
                    add(m, 2)
            for m in _FLAG.finditer(text, low, high):
                add(m, 2)
        if "basic" in part or "bearer" in part or "token" in part or "digest" in part:
            for m in _SCHEME.finditer(text, low, high):
                if m["scheme"].lower() not in ("token", "digest") or len(m["value"]) >= 16 or any(c.isdigit() for c in m["value"]):
                    add(m, 2)
        if ":" in part:
            for m in _HEADER.finditer(text, low, high):
                if names_secret(m["name"]) == 2:
                    add(m, 2)
            for m in _COLON.finditer(text, low, high):
                add(m, 2 if _HEX.fullmatch(m["value"]) and len(m["value"]) >= 32 else 1)
        if "hmac" in part:
            for m in _HMAC.finditer(text, low, high):
                add(m, 2)
        if "(" in part:
            for m in _CALL.finditer(text, low, high):
                opens = "open" in name_parts(m["name"]) and _HEX.fullmatch(m["value"])
                known = opens or {"auth", "login", "connect", "signin", "authenticate", "credentials", "basicauth", "httpbasicauth", "logon"} & set(name_parts(m["name"]))
                add(m, 2 if known else 1)
            for m in _PUT.finditer(text, low, high):
                if names_secret(m["name"]) == 2:
                    add(m, 2)
            if "default" in part:
                for m in _ARGUMENT.finditer(text, low, high):
                    add(m, max(0, names_secret(m["name"])))
            if "env" in part:
                for m in _DEFAULT.finditer(text, low, high):
                    if names_secret(m["name"]) >= 0:
                        add(m, 2)
        if "{" in part:
            for m in _PAIR.finditer(text, low, high):
                add(m, 2)
        if "==" in part or "compare" in part or "equals" in part:
            for m in _COMPARE.finditer(text, low, high):
                add(m, 2 if _GRANTS.search(text, m.end(), min(high, m.end() + 120)) else 0)
        for m in _LOGIN.finditer(text, low, high):
            add(m, 2)
        for m in _TOLD.finditer(text, low, high):
            if names_secret(m["name"].split(" ")[-1]) == 2 or names_secret(m["name"]) == 2:
                add(m, 2)
        if " for " in part or " of " in part:
            for m in _FOR.finditer(text, low, high):
                add(m, 1)
        if "acc" in part or "zugang" in part or "inlog" in part or "meldung" in part or "connexion" in part:
            for m in _ACCESS.finditer(text, low, high):
                add(m, 2)
        if "eyj" in part:
            spans += [(place(m.start()), place(m.end())) for m in _JWT.finditer(text, low, high)]
        for m in _LONG.finditer(text, low, high):
            add(m, 0, 0)
    return _outermost(spans)


def _blank_key(block: str) -> bool:
    body = re.sub(r"-----[A-Z0-9 ]+-----|\\[nrt]|[\s\"'\\+]", "", block)
    return len(body) < 32 or entropy(body) < 4 or bool(re.search(r"(?i)x{8,}|redacted|\.{4,}|\*{4,}|example|placeholder", body))


def _outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without those inside another; where two overlap, the longer."""
    kept: list[tuple[int, int]] = []
    for start, end in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if kept and start < kept[-1][1]:
            if end - start > kept[-1][1] - kept[-1][0]:
                kept[-1] = (start, end)
            continue
        kept.append((start, end))
    return kept


def replaced(text: str, spans: list[tuple[int, int]], mark: str = "REDACTED") -> str:
    """The text with the mark in place of each span; all else stays as it is."""
    out, at = [], 0
    for start, end in spans:
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact(text: str, mark: str = "REDACTED") -> str:
    """The text with each credential replaced."""
    return replaced(text, secrets(text), mark)


def found(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``secret``, distinct. Null keys and texts that are null or empty have none; no row is capped or cut."""
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where("_key is not null and length(_text) > 5")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(k, t[a:b]) for k, t in zip(frame["_key"], frame["_text"], strict=True) for a, b in secrets(t)]
            if out:
                yield pd.DataFrame(out, columns=[key, "secret"])

    return rows.mapInPandas(search, f"{key} {rows.schema['_key'].dataType.simpleString()}, secret string").distinct()


def redacted(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the text with its credentials replaced, and their number; null texts stay null with 0."""
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def clean(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            spans = [secrets(t) if t else [] for t in frame["_text"]]
            texts = [replaced(t, s) if s else t for t, s in zip(frame["_text"], spans, strict=True)]
            yield pd.DataFrame({key: frame["_key"], text: pd.Series(texts, dtype=object, index=frame.index), "n_secrets": [len(s) for s in spans]})

    return rows.mapInPandas(clean, f"{key} {rows.schema['_key'].dataType.simpleString()}, {text} string, n_secrets int")
