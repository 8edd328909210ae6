"""Text predicates as SQL, for Spark and for the DuckDB oracle.

A rule is written once, over these predicates. What differs between the engines
is only how they spell a regular expression, a lambda or a list.
"""

from __future__ import annotations

import re

from .marks import BITS


def literal_of(p: str) -> str:
    """The longest text that every match of a pattern holds, as far as its top level tells; empty if unsure."""
    if "(?i" in p or "\\x" in p or "\\u" in p or "\\Q" in p:
        return ""
    runs, depth, i = [""], 0, 0
    while i < len(p):
        c = p[i]
        if c.isalnum() or c in " _":
            runs[-1] += c if depth == 0 else ""
        elif c == "|" and depth == 0:
            return ""
        else:
            if c in "?*{" and depth == 0:
                runs[-1] = runs[-1][:-1]
            runs.append("")
            depth += (c == "(") - (c == ")")
            if c == "\\":
                i += 1
            elif c in "[{":
                # A class may hold its own closing bracket as an escape or in first place.
                i += 2 if p[i + 1 : i + 2] in ("^", "]", "\\") else 1
                while i < len(p) and p[i] != {"[": "]", "{": "}"}[c]:
                    i += 2 if p[i] == "\\" else 1
        i += 1
    return max(runs, key=len)


def literals_of(p: str) -> list[tuple[str, ...]]:
    """Texts that every match of a pattern holds, one of each tuple: plain runs, and plain alternatives of groups and small classes, at its top level; none if unsure."""
    if literal_of(p + "zzz") == "":
        return []
    plain = r"[^\W_]|[ _]"
    # From left to right: escapes, groups with their quantifier, classes after a run, runs; a quantifier takes the last sign of a run.
    part = re.compile(rf"\\.|\((?:\?:)?(?P<group>[^()\\\[\]?*+{{}}.^$]*)\)(?P<some>[?*{{])?|(?P<head>(?:{plain})+)\[(?P<signs>[^\W_]{{1,4}})\](?![?*{{])|(?P<run>(?:{plain})+)(?P<loose>[?*{{])?|\[\^?\]?(?:\\.|[^\]\\])*\]|\{{[^}}]*\}}|.", re.S)
    held, depth = [], 0
    for m in part.finditer(p):
        if depth == 0 and m["group"] and not m["some"]:
            held.append(tuple(m["group"].split("|")))
        elif depth == 0 and m["signs"]:
            held.append(tuple(m["head"] + c for c in m["signs"]))
        elif depth == 0 and m["run"]:
            held.append((m["run"][:-1] if m["loose"] else m["run"],))
        elif m[0] in ("(", ")"):
            depth += 1 if m[0] == "(" else -1
    return [h for h in held if all(len(t.encode()) > 1 for t in h)]


class Spark:
    """Spark SQL expressions."""

    name = "spark"
    #: Columns that hold a text column's words between single blanks, as ``padded`` makes them; whole words are looked for in them.
    word_columns: dict[str, str] = {}
    #: Java's word signs are ASCII in every version, unlike its boundaries; beside a letter or digit half of the boundary is known.
    edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"

    def text(self, s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def pattern(self, p: str) -> str:
        """An ASCII word boundary, whatever the Java version takes it for."""
        p = re.sub(r"\\b([A-Za-z0-9])(?![?*{])", r"(?<!\\w)\1", p)
        p = re.sub(r"(?<!\\)([A-Za-z0-9])\\b", r"\1(?!\\w)", p)
        return self.text(p.replace("\\b", self.edge))

    def contains(self, x: str, s: str) -> str:
        return f"contains({x}, {self.text(s)})"

    def contains_each(self, x: str, words) -> list[str]:
        """Tests of which one holds where any of the words stands."""
        return [self.contains(x, w) for w in words]

    def whole_each(self, x: str, words) -> list[str]:
        return [self._whole(x, w) for w in words]

    def matches(self, x: str, p: str) -> str:
        """A column is searched by a pattern only where the text stands that every match holds."""
        held = literal_of(p) if x.isidentifier() else ""
        guard = f"{self.contains(x, held)} and " if len(held) > 2 else ""
        return f"({guard}{x} rlike {self.pattern(p)})"

    def extract(self, x: str, p: str, group: int = 1) -> str:
        held = literal_of(p) if x.isidentifier() else ""
        found = f"regexp_extract({x}, {self.pattern(p)}, {group})"
        return f"case when not {self.contains(x, held)} then '' else {found} end" if len(held) > 2 else found

    def extract_all(self, x: str, p: str, group: int = 1) -> str:
        return f"regexp_extract_all({x}, {self.pattern(p)}, {group})"

    def replace(self, x: str, p: str, to: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.text(to)})"

    def each(self, xs: str, f, name: str = "x") -> str:
        return f"transform({xs}, {name} -> {f(name)})"

    def words(self, x: str) -> str:
        return f"split(trim({x}), '\\\\s+', -1)"

    def split_on(self, x: str, p: str) -> str:
        return f"split({x}, {self.text(p)}, -1)"

    def ends_with(self, x: str, end: str) -> str:
        return f"endswith({x}, {self.text(end)})"

    def pairs(self, xs: str, ys: str, f) -> str:
        return f"zip_with({xs}, {ys}, (x, y) -> {f('x', 'y')})"

    def compact(self, items: list[str]) -> str:
        return f"filter(array({', '.join(items)}), x -> x is not null)"

    def present(self, items: list[str]) -> str:
        """The texts that are not null, equal ones once; unlike a lambda's, the items' expressions are compiled."""
        return f"array_except(array({', '.join(items)}), array(cast(null as string)))"

    def size(self, xs: str) -> str:
        return f"size({xs})"

    def total(self, xs: str) -> str:
        return f"aggregate({xs}, 0, (s, x) -> s + x)"

    def largest(self, xs: str) -> str:
        return f"array_max({xs})"

    def lines(self, x: str) -> str:
        """As Java splits lines: empty ones at the end are dropped."""
        return f"split(regexp_replace({x}, '[\\\\r\\\\n]+$', ''), '\\\\r\\\\n|[\\\\r\\\\n]', -1)"

    def keep(self, xs: str, f, name: str = "x") -> str:
        return f"filter({xs}, {name} -> {f(name)})"

    def first_of(self, xs: str, n: str) -> str:
        return f"slice({xs}, 1, {n})"

    def numbers_to(self, n: str) -> str:
        return f"sequence(1, {n})"

    def strings(self, items: list[str]) -> str:
        return f"array({', '.join(items)})"

    def contains_item(self, xs: str, item: str) -> str:
        return f"array_contains({xs}, {self.text(item)})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def signed(self, pattern: str, x: str) -> str:
        return f"format_string('{pattern}', {x})"

    def unnest(self, xs: str) -> str:
        return f"explode({xs})"

    def sorted_texts(self, x: str) -> str:
        """Texts of a group in order, with commas between them."""
        return f"array_join(sort_array(collect_list({x})), ',')"

    def minutes_between(self, a: str, b: str) -> str:
        return f"timestampdiff(minute, {a}, {b})"

    def day(self, x: str) -> str:
        return f"cast({x} as date)"

    def rows(self, alias: str, columns: str, values: list[str]) -> str:
        return f"(select * from values {', '.join(values)} as {alias}({columns}))"

    def fnv(self, x: str) -> str:
        """64-bit FNV-1a of a text of the basic plane as 16 hex digits: two halves of 32 bits, so that nothing overflows."""
        step = "(h, c) -> struct((h.hi * 435 + ((h.lo ^ ascii(c)) * 435 div 4294967296) + (h.lo ^ ascii(c)) * 256) % 4294967296 as hi, ((h.lo ^ ascii(c)) * 435) % 4294967296 as lo)"
        start = "struct(cast(3421674724 as bigint) as hi, cast(2216829733 as bigint) as lo)"
        return f"aggregate(split({x}, ''), {start}, {step}, h -> lower(concat(lpad(hex(h.hi), 8, '0'), lpad(hex(h.lo), 8, '0'))))"

    def glued(self, xs: str, by: str) -> str:
        return f"array_join({xs}, {by})"

    def at(self, xs: str, i: str) -> str:
        return f"try_element_at({xs}, {i})"

    def joined(self, xs: str) -> str:
        return f"array_join({xs}, ',')"

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    # Rules that hold in either dialect.

    def trimmed(self, x: str) -> str:
        """Without signs up to the blank at either end."""
        return f"trim(both '{''.join(rf'\u{i:04x}' for i in range(33))}' from coalesce({x}, ''))"

    def norm(self, x: str) -> str:
        return f"lower({self.trimmed(x)})"

    def padded(self, x: str) -> str:
        """The ASCII words of a text with one blank before, between and after them."""
        return f"(' ' || {self.replace(x, '[^A-Za-z0-9_]+', ' ')} || ' ')"

    def _whole(self, x: str, word: str) -> str | None:
        """A plain word as a substring of its padded text, where there is such a column; what ``has`` finds by boundaries."""
        if x in self.word_columns and word.isascii() and word.replace("_", "a").isalnum():
            return f"contains({self.word_columns[x]}, {self.text(f' {word} ')})"
        return None

    def has(self, x: str, word: str) -> str:
        """A phrase, or a word with a sign or another script, anywhere; a plain word only as a whole."""
        whole = self._whole(x, word)
        if whole:
            return whole
        found = self.contains(x, word)
        if any(c in word for c in " -/") or not word.isascii():
            return found
        return f"({found} and {self.matches(x, rf'\b{self.escaped(word)}\b')})"

    def escaped(self, word: str) -> str:
        return "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in word)

    def any_of(self, x: str, words) -> str:
        """Any word as ``has`` finds it. Plain substrings are looked for first: the expression is searched only where one of its words stands."""
        plain = [w for w in words if not any(c in w for c in " -/") and w.isascii()]
        parts = self.contains_each(x, [w for w in words if w not in plain])
        parts += self.whole_each(x, [w for w in plain if self._whole(x, w)])
        plain = [w for w in plain if not self._whole(x, w)]
        if plain:
            somewhere = " or ".join(self.contains_each(x, plain))
            parts.append(f"(({somewhere}) and {self.matches(x, r'\b(?:' + '|'.join(map(self.escaped, plain)) + r')\b')})")
        return "(" + " or ".join(parts) + ")"

    def inside(self, x: str, words) -> str:
        """Any word as a plain substring."""
        return "(" + " or ".join(self.contains_each(x, words)) + ")"

    def hits(self, x: str, words) -> str:
        return "(" + " + ".join(f"case when {self.has(x, w)} then 1 else 0 end" for w in words) + ")"

    def inside_hits(self, x: str, words) -> str:
        return "(" + " + ".join(f"case when {self.contains(x, w)} then 1 else 0 end" for w in words) + ")"

    def any_pattern(self, x: str, patterns) -> str:
        return "(" + " or ".join(self.matches(x, p) for p in patterns) + ")"

    def pick(self, i: str, values: list[str]) -> str:
        """The i-th value (from 1), null beyond."""
        return f"case {i} " + " ".join(f"when {k} then {v}" for k, v in enumerate(values, 1)) + " end" if values else "null"


class Worded(Spark):
    """Spark SQL over postings whose stages hold the words of text and title."""

    word_columns = {"txt": "txt_words", "n_title": "title_words"}


class Marked(Worded):
    """Spark SQL over postings whose words are told in one pass (``functions.marks``): a test of a word is a bit of ``marks_of`` its column.

    An instance gathers the words that its expressions ask for, so all of them are made before the marks are.
    """

    def __init__(self):
        self.words: dict[str, dict[tuple[str, bool], int]] = {x: {} for x in self.word_columns}

    def marks_of(self, x: str) -> str:
        return f"{x}_marks"

    def _bit(self, x: str, word: str, whole: bool) -> int:
        return self.words[x].setdefault((word, whole), len(self.words[x]))

    def _each(self, x: str, bits) -> list[str]:
        """A test for each number of marks that has one of the bits."""
        masks: dict[int, int] = {}
        for b in bits:
            masks[b // BITS] = masks.get(b // BITS, 0) | 1 << b % BITS
        return [f"({self.marks_of(x)}[{i}] & {mask}L) <> 0" for i, mask in masks.items()]

    def contains(self, x: str, s: str) -> str:
        return self.contains_each(x, [s])[0]

    def contains_each(self, x: str, words) -> list[str]:
        if x not in self.words or not all(words):
            return [super(Marked, self).contains(x, w) for w in words]
        return [f"({t})" for t in self._each(x, [self._bit(x, w, False) for w in words])]

    def whole_each(self, x: str, words) -> list[str]:
        return [f"({t})" for t in self._each(x, [self._bit(x, w, True) for w in words])]

    def _whole(self, x: str, word: str) -> str | None:
        return self.whole_each(x, [word])[0] if super()._whole(x, word) else None

    def _may(self, x: str, p: str) -> str:
        """Whether a column holds all that a match of the pattern holds; empty if nothing is known."""
        return " and ".join("(" + " or ".join(self.contains_each(x, h)) + ")" for h in literals_of(p)) if x in self.words else ""

    def matches(self, x: str, p: str) -> str:
        may = self._may(x, p)
        return f"({may} and {x} rlike {self.pattern(p)})" if may else super().matches(x, p)

    def extract(self, x: str, p: str, group: int = 1) -> str:
        may = self._may(x, p)
        return f"case when {may} then regexp_extract({x}, {self.pattern(p)}, {group}) else '' end" if may else super().extract(x, p, group)

    def extract_all(self, x: str, p: str, group: int = 1) -> str:
        may, found = self._may(x, p), super().extract_all(x, p, group)
        return f"case when {may} then {found} else cast(array() as array<string>) end" if may else found

    def hits(self, x: str, words) -> str:
        """Of words that are told by a bit, the bits are counted."""
        told = [w for w in words if x in self.words and w and (self._whole(x, w) or any(c in w for c in " -/") or not w.isascii())]
        if not told or len(set(words)) < len(words):
            return super().hits(x, words)
        tests = [self._each(x, [self._bit(x, w, bool(self._whole(x, w))) for w in told])]
        counted = [f"bit_count({t.removesuffix(' <> 0')})" for t in tests[0]]
        return "(" + " + ".join(counted + [f"case when {self.has(x, w)} then 1 else 0 end" for w in words if w not in told]) + ")"


class DuckDB(Spark):
    """The same for DuckDB."""

    name = "duckdb"

    def text(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def pattern(self, p: str) -> str:
        return self.text(p)

    def matches(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.pattern(p)})"

    def extract(self, x: str, p: str, group: int = 1) -> str:
        return f"regexp_extract({x}, {self.pattern(p)}, {group})"

    def present(self, items: list[str]) -> str:
        return self.compact(items)

    def extract_all(self, x: str, p: str, group: int = 1) -> str:
        return f"list_transform(regexp_extract_all({x}, {self.pattern(p)}, {group}), lambda z: coalesce(z, ''))"

    def replace(self, x: str, p: str, to: str) -> str:
        return f"regexp_replace({x}, {self.pattern(p)}, {self.text(to)}, 'g')"

    def each(self, xs: str, f, name: str = "x") -> str:
        return f"list_transform({xs}, lambda {name}: {f(name)})"

    def trimmed(self, x: str) -> str:
        return self.replace(f"coalesce({x}, '')", r"^[\x00-\x20]+|[\x00-\x20]+$", "")

    def words(self, x: str) -> str:
        return f"string_split_regex(trim({x}), '\\s+')"

    def split_on(self, x: str, p: str) -> str:
        return f"string_split_regex({x}, {self.text(p)})"

    def ends_with(self, x: str, end: str) -> str:
        return f"suffix({x}, {self.text(end)})"

    def pairs(self, xs: str, ys: str, f) -> str:
        return f"list_transform(list_zip({xs}, {ys}), lambda z: {f('z[1]', 'z[2]')})"

    def compact(self, items: list[str]) -> str:
        return f"list_filter([{', '.join(items)}], lambda x: x is not null)"

    def size(self, xs: str) -> str:
        return f"len({xs})"

    def total(self, xs: str) -> str:
        return f"coalesce(list_sum({xs}), 0)"

    def largest(self, xs: str) -> str:
        return f"list_max({xs})"

    def lines(self, x: str) -> str:
        return f"string_split_regex(regexp_replace({x}, '[\\r\\n]+$', ''), '\\r\\n|[\\r\\n]')"

    def keep(self, xs: str, f, name: str = "x") -> str:
        return f"list_filter({xs}, lambda {name}: {f(name)})"

    def first_of(self, xs: str, n: str) -> str:
        return f"({xs})[1:{n}]"

    def numbers_to(self, n: str) -> str:
        return f"range(1, {n} + 1)"

    def strings(self, items: list[str]) -> str:
        return f"[{', '.join(items)}]"

    def contains_item(self, xs: str, item: str) -> str:
        return f"list_contains({xs}, {self.text(item)})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def signed(self, pattern: str, x: str) -> str:
        return f"printf('{pattern}', {x})"

    def unnest(self, xs: str) -> str:
        return f"unnest({xs})"

    def sorted_texts(self, x: str) -> str:
        return f"string_agg({x}, ',' order by {x})"

    def minutes_between(self, a: str, b: str) -> str:
        return f"datediff('second', {a}, {b}) // 60"

    def rows(self, alias: str, columns: str, values: list[str]) -> str:
        return f"(select * from (values {', '.join(values)}) as {alias}({columns}))"

    def fnv(self, x: str) -> str:
        codes = f"list_transform(string_split({x}, ''), lambda c: unicode(c)::hugeint)"
        return f"lpad(lower(hex(list_reduce(list_prepend(14695981039346656037::hugeint, {codes}), lambda a, c: (xor(a, c) * 1099511628211::hugeint) % 18446744073709551616::hugeint)::ubigint)), 16, '0')"

    def glued(self, xs: str, by: str) -> str:
        return f"coalesce(array_to_string({xs}, {by}), '')"

    def at(self, xs: str, i: str) -> str:
        return f"({xs})[{i}]"

    def joined(self, xs: str) -> str:
        return f"coalesce(array_to_string({xs}, ','), '')"

    def div(self, a: str, b: str) -> str:
        return f"({a} // {b})"


SPARK, WORDED, DUCKDB = Spark(), Worded(), DuckDB()
