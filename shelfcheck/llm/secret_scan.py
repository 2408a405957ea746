"""Secret scan by assignment-aware lexing.

Three fixed patterns give the base spans. Beside them each text is lexed as source or configuration: names,
string literals, bare words and the marks between them become pairs (name, literal) for ``name = "x"``,
``name: x``, ``"name": "x"``, ``name := x``, ``export NAME=x``, ``a["name"] = x``, ``name: type = x``,
``var name type = x``, ``#define NAME "x"``, ``f("name", "x")``, ``<name>x</name>``, ``key="name" value="x"``, a YAML value
on the next line, parenthesised, prefixed and triple-quoted strings, and for keyword arguments; a literal that is
the name of an earlier assignment takes that one's value (constants are propagated, joined with ``+`` as well), so
``k = "..."; password = k`` is found at the first place too. A literal scores by the sensitive words in its target
name, its length, its kinds of characters and its entropy; from ``LEAST`` on it is a span of kind ``lexed``, unless
it is covered by a base span. A credential scheme before a value (``Bearer x``) belongs to the name.

Strings are found from one pass over all quotation marks from the end, which says for each of them where it would be
closed on its line, so a mark that is never closed costs no second look and the time follows the text's length,
however long it is. A quotation mark behind a letter or digit opens nothing (``don't``), unless that is a string
prefix; nor does one whose string would end directly behind a mark of assignment, as then the closing one opens the
value. Escaped quotation marks pair with others escaped alike, so JSON within strings is read as well. Of spans that
start at one place each is given once; ties have no other effect.

Null texts are empty. Rows keep their order and number; repeated rows each have a result. Empty tables give empty
results. Other columns are ignored by the scan and kept by ``redacted``. Spans are counted in code points.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "lexed")

#: Words of a target name and what each adds to a literal's score.
NAME_WEIGHTS = {
    "password": 0.6, "passwd": 0.6, "passphrase": 0.6, "pwd": 0.5, "pass": 0.4, "secret": 0.6, "token": 0.5, "apikey": 0.6,
    "api": 0.2, "key": 0.3, "private": 0.3, "access": 0.2, "auth": 0.3, "credential": 0.5, "credentials": 0.5, "signature": 0.2,
    "client": 0.1, "bearer": 0.4, "salt": 0.2, "connection": 0.1, "authorization": 0.4, "signing": 0.3, "encryption": 0.3,
    "decryption": 0.3, "encrypt": 0.3, "decrypt": 0.3, "cipher": 0.3, "hmac": 0.3, "master": 0.2, "webhook": 0.1,
}
#: Words without weight that are written together with those above.
_BESIDE = ("db", "user", "usr", "my", "app", "aws", "admin", "root", "server", "service", "id", "sql", "pg", "mysql", "redis", "mail",
           "smtp", "ftp", "ssh", "jwt", "web", "host", "login", "account", "oauth", "shared", "session", "test", "prod", "dev")
LEAST, SHORTEST = 0.6, 8
#: Of a value put together from more characters than this, ``pairs`` gives so many; the value itself has no bound.
LONGEST = 4096


def hints() -> list[str]:
    """Words of which every name that can reach ``LEAST`` holds one: all but the lightest, which together fall short."""
    need, out = (LEAST - 0.4) / 0.6 - 1e-5, []
    total = 0.0
    for word, weight in sorted(NAME_WEIGHTS.items(), key=lambda x: x[1]):
        total += weight
        if total >= need:
            out.append(word)
    return sorted(x for x in out if not any(y != x and y in x for y in out))


_HINT = re.compile("|".join(hints()))
_MARKED = re.compile(r"""[=:]|#[ \t]*define|</|["'][ \t]*,""")
_TOKEN = re.compile(r"""
    (?P<name>[A-Za-z_][A-Za-z0-9_.\-]*)
  | (?P<op>:=|=>|==|!=|<=|>=|[=:+,;(){}\[\]])
  | (?P<bare>[A-Za-z0-9/][A-Za-z0-9+/_.=\-]*)
  | (?P<line>\n)
  | (?P<other>[^\s])
""", re.X | re.A)
_QUOTES = re.compile(r"""\\+|["'`\n]""")
_PREFIXES = frozenset("r f b u rb br fr rf R F B U L".split())
_LIFETIME = re.compile(r"[a-z_]+\s", re.A)
_ELEMENT = re.compile(r"<([A-Za-z_][\w.:\-]{0,80})(?:[ \t][^<>\n]*)?>\s*([^<>\s]{8,})\s*</")
_ATTRIBUTES = re.compile(r"""\b(?:key|name|id)=(["'])([^"'<>\n]{1,120})\1[ \t]+value=(["'])([^"'<>\n]+)\3""")
_SCHEMES = frozenset("bearer basic token apikey".split())
_MARKS = ("=", ":", ":=", "=>")
#: Words after which, or as which, a name before a colon is not declared there.
_FLOW = frozenset(("if elif else while for in and or not is case when switch default try finally except catch with as return lambda do"
                   " then class").split())
#: Words that stand before the name of a type, and names of types that stand behind the name declared.
_BEFORE_TYPES = frozenset("mut const dyn readonly unsigned".split())
_TYPES = frozenset("string str byte rune text varchar char".split())
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)


def entropy(text: str) -> float:
    """Bits for each character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


@cache
def name_words(part: str) -> tuple[str, ...]:
    """The weighted words of one lower-case part of a name: itself, its singular, or words written together."""
    for x in (part, part.removesuffix("s")):
        if x in NAME_WEIGHTS:
            return (x,)
    if not 4 <= len(part) <= 40:
        return ()
    ends: list = [()] + [None] * len(part)  # the words that make up each beginning, longer ones first
    for at in range(len(part)):
        if ends[at] is None:
            continue
        for word in _TOGETHER:
            if part.startswith(word, at) and ends[at + len(word)] is None:
                ends[at + len(word)] = (*ends[at], word)
    found = ends[-1] if ends[-1] is not None else ends[-2] if part.endswith("s") and ends[-2] else ()
    return tuple(x for x in found if x in NAME_WEIGHTS)


_TOGETHER = sorted([*NAME_WEIGHTS, *_BESIDE], key=lambda x: (-len(x), x))


def name_score(name: str) -> float:
    if len(name) > 400:
        name = name[-400:]  # the last parts name the value
    found = dict.fromkeys(w for x in _PARTS.findall(name) for w in name_words(x.lower()))
    return min(1.0, sum(NAME_WEIGHTS[w] for w in found))


def _score(name: str, counts: dict[str, int], n: int) -> float:
    """0 to 1 for a literal of n characters, by how often it has each of them."""
    if n < SHORTEST or any(c.isspace() for c in counts):
        return 0.0
    kinds = sum(any(t(c) for c in counts) for t in (str.islower, str.isupper, str.isdigit)) + (not all(c.isalnum() for c in counts))
    bits = -sum(c / n * math.log2(c / n) for c in counts.values())
    shape = min(1.0, bits / 4) * (0.5 if kinds < 2 else 1.0)
    return round(0.6 * name_score(name) + 0.4 * shape, 6)


def literal_score(name: str, literal: str) -> float:
    """0 to 1: how likely the literal, given to this name, is a secret."""
    return _score(name, Counter(literal), len(literal))


class Value:
    """A literal, or literals joined: its length (rounded beyond 2**512 characters), the counts of its characters and its parts, which are shared.

    ``text`` is the whole value, or the first LONGEST characters of a longer joined one. ``parts`` is a place
    (start, end) or a list of two ``parts``.
    """

    __slots__ = ("text", "length", "parts", "_counts")

    def __init__(self, text: str, length: int, parts, counts: Counter | None = None):
        self.text, self.length, self.parts, self._counts = text, length, parts, counts

    @property
    def counts(self) -> Counter:
        return Counter(self.text) if self._counts is None else self._counts

    def __add__(self, other: Value) -> Value:
        length, counts, text = self.length + other.length, None, self.text
        if length > LONGEST:
            counts = self.counts + other.counts
            if length >> 512:  # only x = x + x again and again gets there; the shares stay and the numbers stay short
                counts = Counter({c: k >> 256 or 1 for c, k in counts.items()})
                length = counts.total()
        if self.length == len(self.text):
            text += other.text
        return Value(text if length <= LONGEST else text[:LONGEST], length, [self.parts, other.parts], counts)


def _places(parts, seen: dict[int, object]) -> list[tuple[int, int]]:
    """The places in ``parts`` that are not in ``seen``, each once."""
    out, todo = [], [parts]
    while todo:
        x = todo.pop()
        if id(x) not in seen:
            seen[id(x)] = x
            if isinstance(x, tuple):
                out.append(x)
            else:
                todo += reversed(x)
    return out


def _closings(text: str) -> dict[int, tuple[int, int]]:
    """For every quotation mark that can open a string on its line: where the string ends, and the closing mark.

    A mark is escaped by an odd number of backslashes. An unescaped one is closed by the next of its kind that is not
    escaped; an escaped one by the next with as many backslashes; a backtick by the next backtick.
    """
    marks, run = [], (0, 0)
    for m in _QUOTES.finditer(text):
        said, a = m.group(), m.start()
        if said[0] == "\\":
            run = (m.end(), len(said))
        else:
            before = run[1] if run[0] == a else 0
            marks.append((a, said, before if before % 2 and said != "`" else 0))
    out, last = {}, {}
    for a, said, escapes in reversed(marks):
        if said == "\n":
            last = {}
        else:
            if (end := last.get((said, escapes))) is not None:
                out[a] = (end - escapes, end)
            last[said, escapes] = a
    return out


def _opens(text: str, a: int, end: int) -> bool:
    """Whether the quotation mark at a, whose string would end at ``end``, opens one."""
    before = text[a - 1] if a else ""
    if before.isalnum() or before == "_":
        b = a - 1
        while b and a - b < 3 and text[b - 1].isalnum():
            b -= 1
        if text[b:a] not in _PREFIXES or b and (text[b - 1].isalnum() or text[b - 1] == "_"):
            return False
    if before == "&" and text[a] == "'" and _LIFETIME.match(text, a + 1):
        return False
    b = end
    while b > a + 1 and text[b - 1] in " \t":
        b -= 1
    if b > a + 1 and text[b - 1] in "=:":  # what would close the string may open a value
        while a and text[a - 1] in " \t":
            a -= 1
        return bool(a) and text[a - 1] in "=:,({[+>"
    return True


def _tokens(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end); a string's value and place are those between its quotes, in time linear in the text."""
    out, closings, at, open_ended = [], _closings(text), 0, set()
    for m in iter(lambda: _TOKEN.search(text, at), None):
        kind, a, at = m.lastgroup, m.start(), m.end()
        value = m.group()
        if kind == "other" and value in "\"'`":
            if value != "`" and text.startswith(value * 3, a) and value not in open_ended:
                end = text.find(value * 3, a + 3)
                if end < 0:
                    open_ended.add(value)
                else:
                    inner = text[a + 3 : end]
                    start = a + 3 + len(inner) - len(inner.lstrip())
                    inner = inner.strip()
                    out.append(("string", inner, start, start + len(inner)))
                    at = end + 3
                    continue
            if a in closings and _opens(text, a, closings[a][0]):
                end, at = closings[a][0], closings[a][1] + 1
                if out and out[-1][0] == "name" and out[-1][3] == a and out[-1][1] in _PREFIXES:
                    out.pop()
                while end + 1 < at and out and out[-1][1] == "\\":  # the escapes of an escaped mark
                    out.pop()
                out.append(("string", text[a + 1 : end], a + 1, end))
                continue
        out.append((kind, value, a, at))
    return out


def _brackets(tokens) -> dict[int, int]:
    """Place of the opening bracket of every closing one."""
    opens, out = [], {}
    for i, (kind, said, _, _) in enumerate(tokens):
        if kind == "op" and said == "[":
            opens.append(i)
        elif kind == "op" and said == "]" and opens:
            out[i] = opens.pop()
    return out


def _path(tokens, opens: dict[int, int], j: int) -> tuple[str, int]:
    """The operand that ends at token j, as a name with its subscripts joined by dots, and its first token."""
    parts, first = [], j + 1
    while j >= 0:
        kind, said = tokens[j][:2]
        if kind in ("name", "string"):
            parts.append(said)
            first = j
            if kind == "name" and j > 1 and tokens[j - 1][1] == "." and j - 2 in opens:
                j -= 2
                continue
            break
        if j not in opens:
            break
        first, j = opens[j], j - 1
        while j > first:
            if tokens[j][0] in ("name", "string"):
                parts.append(tokens[j][1])
            j = opens.get(j, j) - 1
        j = first - 1
        if j < 0 or tokens[j][0] != "name" and j not in opens:
            break
    return ".".join(reversed(parts)), first


def _after_type(tokens, i: int) -> int | None:
    """Place of the ``=`` behind the type that starts at token i, on one line."""
    depth, word, first = 0, False, i
    while i < len(tokens):
        kind, said = tokens[i][:2]
        if kind in ("name", "string", "bare"):
            if word:
                return None
            word = said not in _BEFORE_TYPES and tokens[i - 1][1] != "'"
        elif kind == "op" and (said == "=" and not depth or said == ">=" and depth == 1):
            return i if i > first else None
        elif said in ("[", "<"):
            depth, word = depth + 1, False
        elif said in ("]", ">") and depth:
            depth, word = depth - 1, True
        elif kind == "other" and said in "|&*?!'." or said == "," and depth:
            word = False
        else:
            return None
        i += 1
    return None


def _typed(tokens, opens: dict[int, int], first: int, least: int) -> int | None:
    """Place of the name on the same line before what starts at token ``first``, over ``*``, ``&`` and ``[]``."""
    j = first - 1
    while j >= least:
        if tokens[j][0] == "name":
            return j
        if tokens[j][1] in ("*", "&"):
            j -= 1
        elif j in opens and all(t[0] == "bare" for t in tokens[max(opens[j] + 1, j - 2) : j]) and j - opens[j] <= 2:
            j = opens[j] - 1
        else:
            return None
    return None


class _Known(dict):
    """Constants by name; ``longest`` is the length of the longest name."""

    longest = 0

    def learn(self, names, value: Value) -> None:
        self.update(dict.fromkeys(names, value))
        self.longest = max([self.longest, *map(len, names)])


def _read(tokens, known, j: int):
    """The known constant that the operand at token j names, subscripts included, and the token behind it."""
    found, said, k = None, tokens[j][1], j + 1
    if said in known:
        found = known[said], k
    while k + 2 < len(tokens) and len(said) < known.longest and tokens[k][1] == "[" and tokens[k + 1][0] in ("string", "name") and tokens[k + 2][1] == "]":
        said, k = f"{said}.{tokens[k + 1][1]}", k + 3
        if said in known:
            found = known[said], k
    return found


_NAME = re.compile(r"[A-Za-z_][\w.\- ]{0,79}", re.A).fullmatch


def _next_line(tokens, j: int) -> int:
    """Place of a YAML value that stands alone on the line after its name, behind a block mark or none; else j."""
    i = j
    while i < len(tokens) and tokens[i][1] in ("|", ">", "-") and i - j < 2:
        i += 1
    if i + 1 < len(tokens) and tokens[i][0] == "line" and tokens[i + 1][0] in ("string", "bare", "name"):
        if i + 2 >= len(tokens) or tokens[i + 2][0] == "line":
            return i + 1
    return j


def elements(text: str) -> list[tuple[str, Value]]:
    """(name, value) of XML elements that hold one word, and of attributes key and value."""
    out = [(m.group(1), m.start(2), m.end(2)) for m in _ELEMENT.finditer(text)]
    out += [(m.group(2), m.start(4), m.end(4)) for m in _ATTRIBUTES.finditer(text)]
    return [(name, Value(text[a:b], b - a, (a, b))) for name, a, b in out]


def pairs(text: str) -> list[tuple[str, str, list[tuple[int, int]]]]:
    """(target name, value, places of its literals) of every assignment; a joined value up to LONGEST characters."""
    return [(name, value.text, _places(value.parts, {})) for name, value in assignments(text)]


def assignments(text: str) -> list[tuple[str, Value]]:
    """(target name, value) of every assignment, constants propagated.

    The target of a mark is the operand before it: a name, a string, or either with subscripts (``a["b"] =`` is
    ``a.b``). With a type between, in ``name: type =`` and ``name type =``, the name before the type is a target
    too. ``name type =`` cannot be told from ``type name =``, so there both are.
    """
    tokens, known, out, done = _tokens(text), _Known(), [], 0
    opens = _brackets(tokens)
    place = lambda name, j: out.append((name, Value(tokens[j][1], len(tokens[j][1]), tokens[j][2:])))
    for m in range(1, len(tokens) - 1):
        kind, mark = tokens[m][:2]
        if kind == "name" and mark == "define" and tokens[m - 1][1] == "#" and m + 2 < len(tokens):
            if tokens[m + 1][0] == "name" and tokens[m + 2][0] in ("string", "bare"):
                place(tokens[m + 1][1], m + 2)
            continue
        if kind == "op" and mark == "," and tokens[m - 1][0] == tokens[m + 1][0] == "string" and m > 1 and tokens[m - 2][1] == "(":
            if _NAME(tokens[m - 1][1]):
                place(tokens[m - 1][1], m + 1)
            continue
        if mark not in _MARKS or kind != "op" or m <= done:
            continue
        last = m - 1
        if mark == ":" and tokens[last][1] in ("?", "!") and last:
            last -= 1
        if last < done or tokens[last][0] not in ("name", "string") and last not in opens:
            continue
        name, first = _path(tokens, opens, last)
        if not name:
            continue
        plain, start, names, keep = last == m - 1 and last not in opens, m + 1, [name], [name]
        if mark == ":":
            before = tokens[first - 1][:2] if first else ("line", "")
            after = _after_type(tokens, start)
            valued = after is not None and after + 1 < len(tokens) and (
                tokens[after + 1][0] == "string" or tokens[after + 1][0] == "name" and _read(tokens, known, after + 1))
            if valued and name not in _FLOW and (before[0] in ("line", "other") or before[1] in tuple(";({,[") or before[0] == "name" and before[1] not in _FLOW):
                names, start = [name, _path(tokens, opens, after - 1)[0]], after + 1
            elif valued:
                continue  # a statement behind a colon: its own mark follows
            elif not plain and tokens[start][0] != "string":
                continue
        elif mark == "=" and (t := _typed(tokens, opens, first, done)) is not None:
            names.append(tokens[t][1])
            if t and tokens[t - 1][1] in ("var", "const", "let") or name in _TYPES:
                keep = [tokens[t][1]]
        j, value = start, None
        while j < len(tokens) and tokens[j][0] == "op" and tokens[j][1] in ("(", "["):
            j += 1
        if tokens[j - 1][1] == "[":  # all but the last of a list of strings; the last is read as any value
            while j + 2 < len(tokens) and tokens[j][0] == "string" and tokens[j + 1][1] == ",":
                after = j + 2 + (tokens[j + 2][0] == "line")
                if after >= len(tokens) or tokens[after][0] != "string":
                    break
                for x in filter(None, names):
                    place(x, j)
                j = after
        if mark == ":":
            j = _next_line(tokens, j)
        if j + 1 < len(tokens) and tokens[j][0] == "name" and tokens[j][1].lower() in _SCHEMES and tokens[j + 1][0] in ("bare", "name"):
            names, j = [f"{x}.{tokens[j][1]}" for x in names if x], j + 1
        while j < len(tokens):
            kind, said, a, b = tokens[j]
            if kind == "name" and (got := _read(tokens, known, j)):
                one, j = got
            elif kind == "name" and j + 1 < len(tokens) and tokens[j + 1][1] == "(":
                break  # a call, not a literal
            elif kind in ("string", "bare", "name"):
                if kind == "string" and " " in said:
                    scheme, _, rest = said.partition(" ")
                    if scheme.lower() in _SCHEMES and rest and " " not in rest:
                        names, said, a = [f"{x}.{scheme}" for x in names if x], rest, b - len(rest)
                one, j = Value(said, len(said), (a, b)), j + 1
            else:
                break
            value = one if value is None else value + one
            if j < len(tokens) and tokens[j][1] == "+" and tokens[j][0] == "op":
                j += 1
                continue
            break
        if value is not None:
            out += [(x, value) for x in names if x]
            known.learn(keep, value)
            done = j
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the three patterns, leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m.group()) >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def lexed_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Literals of sensitive names that no base span covers. A text without any word of ``hints`` has none."""
    low = text.lower()
    if not _HINT.search(low) or not _MARKED.search(text):
        return []
    found, seen = set(), {}
    for name, value in assignments(text) + (elements(text) if ">" in text else []):
        if value.length >= SHORTEST and 0.6 * name_score(name) + 0.4 >= LEAST - 1e-5 and _score(name, value.counts, value.length) >= LEAST:
            found.update((a, 3, b) for a, b in _places(value.parts, seen))
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    covered = lambda a, b: (i := bisect_right(starts, a)) > 0 and reach[i - 1] >= b
    return sorted(x for x in found if not covered(x[0], x[2]))


def _said(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, base_sha256 and spans ("kind:start:end", by start, then kind)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            counts, shas, spans = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                counts.append([sum(k == kind for _, k, _ in base) for kind in range(3)])
                shas.append(hashlib.sha256(_said(base).encode()).hexdigest())
                spans.append(_said(sorted(base + lexed_spans(text, base))))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), *[pa.array([c[k] for c in counts], pa.int64()) for k in range(3)],
                pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(
        run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[REDACTED]") -> str | None:
    """The text with every span, overlapping ones together, replaced by the mark."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for a, _, b in sorted(base + lexed_spans(text, base)):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]]) if at else text


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """All rows and columns, secrets in the text replaced."""
    at = docs.columns.index(text_col)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = pa.array([redact(x.as_py(), mark) for x in batch.column(at)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)

    return docs.mapInArrow(run, docs.schema)
