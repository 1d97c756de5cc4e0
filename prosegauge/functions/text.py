"""Text functions as Column expressions.

Regexes are written in RE2's dialect, the one that rule files use; jdk() says the same to java.util.regex.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, for trimming.
SPACE = r"\x{9}-\x{d} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"[\p{L}\p{N}]+"
SENTENCE_END = r"""([.!?…]+[)"»']*)\s"""
LIST_ITEM = r"^\s*(?:[-*•]|\d+[.)])\s+\S"
CYRILLIC = "А-Яа-яЁё"
CYRILLIC_WORD = r"[А-Яа-яЁё][А-Яа-яЁё-]*"

# Suffixes and stop words that results depend on.
NOMINAL_SUFFIXES = ["ение", "ания", "ения", "ание", "ация", "изация", "ировка", "ость", "остей", "ений", "аний"]
VERB_SUFFIXES = ["ться", "тся", "ешь", "ишь", "ете", "ите", "ают", "яют", "уют", "юют", "ует", "ирует", "ял", "ил", "ал", "ла", "ли", "ло", "вший", "вшая"]
HEADING_STOPWORDS = ["и", "в", "на", "с", "к", "по", "для", "из", "о", "об", "а", "но", "или", "у", "за"]
PHRASE_STOPWORDS = ["и", "в", "на", "с", "по", "для", "что", "это", "не", "а", "но", "или", "к", "у", "из", "о", "за", "от", "то", "же", "как", "бы", "все", "так", "the", "a", "an", "of", "in", "to", "is", "are", "and", "or", "but", "for", "that", "this", "it", "on", "at", "by", "as", "with", "from", "be", "was", "were"]
COMMENT_STOPWORDS = ["a", "an", "the", "is", "are", "to", "of", "for", "and", "or", "this", "that", "it", "in", "on", "by", "we", "will", "function", "method", "get", "set", "has", "was", "new", "make", "create", "return", "returns", "check", "и", "в", "на", "для", "это", "не", "с", "по", "из", "что", "получить", "вернуть", "создать", "проверить", "установить"]
LONG_WORD, SHORT_FORM, REPEATED = 10, 5, 3

_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_BLANK = r"\t\n\f\r "


def jdk(pattern: str) -> str:
    r"""RE2 to java.util.regex: \b, \s and $ differ, and letters of all alphabets fold in (?i)."""
    out, in_class, k = [], False, 0
    multiline = "(?m" in pattern or "(?im" in pattern or "(?sm" in pattern or "(?ms" in pattern
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            two = pattern[k : k + 2]
            if two == r"\s":
                out.append(_BLANK if in_class else f"[{_BLANK}]")
            elif two == r"\S" and not in_class:
                out.append(f"[^{_BLANK}]")
            elif two == r"\b" and not in_class:
                out.append(_EDGE)
            else:
                out.append(two)
            k += 2
            continue
        if c == "[" and not in_class:
            in_class = True
            out.append(c)
            if pattern[k + 1 : k + 2] == "^":
                out.append("^")
                k += 1
        elif c == "[" and in_class and pattern[k + 1 : k + 2] != ":":
            out.append(r"\[")  # a bracket in a class is itself in RE2
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        elif c == "&" and in_class and pattern[k + 1 : k + 2] == "&":
            out.append(r"\&")
        elif c == "$" and not in_class and not multiline:
            out.append(r"\z")
        else:
            out.append(c)
        k += 1
    return "(?ud)" + "".join(out)


def _alternatives(pattern: str) -> list[str]:
    """pattern cut at the bars that stand in no group or class."""
    out, depth, in_class, start, k = [], 0, False, 0, 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\":
            k += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            out.append(pattern[start:k])
            start = k + 1
        k += 1
    return [*out, pattern[start:]]


def needed(pattern: str, least: int = 3) -> list[str]:
    """Lower-case texts of which every match of a case-folding pattern has one; none if that can't be told.

    Looks at plain characters outside groups and classes alone, so it may miss some but promises none in vain.
    """
    while pattern.startswith(("(?i)", "(?m)", "(?im)")):
        pattern = pattern[pattern.index(")") + 1 :]
    out = []
    for part in _alternatives(pattern):
        runs, run, k = [], "", 0
        while k < len(part):
            c, step, plain = part[k], 1, ""
            if c == "\\":
                two = part[k + 1 : k + 2]
                step = part.index("}", k) + 1 - k if two in "pPx" and part[k + 2 : k + 3] == "{" else 2
                plain = "" if two.isalnum() else two
            elif c == "[":
                end = k + 1
                while part[end] != "]" or end == k + 1:
                    end += 2 if part[end] == "\\" else 1
                step = end + 1 - k
            elif c == "(":
                depth, end = 0, k
                while True:
                    if part[end] == "\\":
                        end += 1
                    elif part[end] == "[":
                        while part[end] != "]":
                            end += 2 if part[end] == "\\" else 1
                    elif part[end] in "()":
                        depth += 1 if part[end] == "(" else -1
                        if not depth:
                            break
                    end += 1
                step = end + 1 - k
            elif c not in ".^$*+?{}":
                plain = c
            after = part[k + step : k + step + 1]
            optional = after in ("?", "*") or after == "{"
            if plain and not optional:
                run += plain
                if after == "+":
                    runs.append(run)
                    run = ""
            else:
                runs.append(run)
                run = ""
            k += step
            if after == "{":
                k = part.index("}", k) + 1
            while k < len(part) and part[k] in "?*+":
                k += 1
        best = max([*runs, run], key=len)
        if len(best) < least:
            return []
        out.append(best.lower())
    return sorted(set(out))


def _group_end(part: str, k: int) -> int:
    """The place past the group or class that opens at k."""
    depth, in_class = 0, False
    while True:
        c = part[k]
        if c == "\\":
            k += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            k += part[k + 1] == "^"
        elif c in "()":
            depth += 1 if c == "(" else -1
        k += 1
        if not depth and not in_class:
            return k


def demands(pattern: str, least: int = 2, edge: bool = False) -> list[list[list[tuple[str, bool]]]]:
    """Lower-case texts for which a match of a case-folding pattern can be looked up before the regex is run: for each
    alternative a list of demands, all of which its matches meet, each by one of some texts.  With each text, whether
    it begins a word wherever it is matched.  An alternative may demand nothing, as do those bound to the start of the
    text, where the regex is as cheap.

    Plain characters and the alternatives of groups count, and small classes of characters beyond ASCII.  edge: the
    pattern itself begins where a word does.
    """
    flags = re.match(r"(?:\(\?[a-z]+\))*", pattern).group()
    pattern = pattern[len(flags) :]
    if re.match(r"\((?!\?[^:])", pattern) and _group_end(pattern, 0) == len(pattern):
        return demands(pattern[1:-1].removeprefix("?:"), least, edge)
    out = []
    for part in _alternatives(pattern):
        found, run, lead, at_edge, k = [], "", edge, edge, 0
        while k < len(part):
            c, step, plain, choice, space = part[k], 1, "", [], False
            if c == "\\":
                two = part[k + 1]
                step = part.index("}", k) + 1 - k if two in "pPx" and part[k + 2 : k + 3] == "{" else 4 if two == "x" else 2
                plain = chr(int(part[k + 2 : k + step].strip("{}"), 16)) if two == "x" else "" if two.isalnum() else two
                space = two == "s"
            elif c in "([":
                step = _group_end(part, k) - k
                inner = part[k + 1 : k + step - 1]
                if c == "[":
                    members = re.findall(r"\\x\{([0-9a-f]+)\}", inner)
                    choice = [(chr(int(m, 16)).lower(), False) for m in members] if re.fullmatch(r"(?:\\x\{[0-9a-f]+\})+", inner) and all(int(m, 16) > 127 for m in members) else []
                elif inner.startswith("?:") or not inner.startswith("?"):
                    each = [max(d, key=lambda x: (all(y[1] for y in x), min(len(y[0]) for y in x)), default=[]) for d in demands(inner.removeprefix("?:"), least, at_edge)]
                    choice = [x for d in each for x in d] if all(each) else []
            elif c not in ".^$*+?{}|":
                plain = c
            after = part[k + step : k + step + 1]
            optional = after in ("?", "*") or after == "{"
            if plain and not optional:
                lead = lead if run else at_edge
                run += plain
            if choice and not optional:
                found.append(sorted(set(choice)))
            at_edge = space and not optional
            if not plain or optional or after == "+":
                found.append([(run, lead)])
                run = ""
            k += step
            if after == "{":
                k = part.index("}", k) + 1
            while k < len(part) and part[k] in "?*+":
                k += 1
        found.append([(run, lead)])
        enough = lambda x: len(x) >= least or (x and not x.isascii()) or (x and not x.isalnum() and not x.isspace())
        out.append([[(x.lower(), begins) for x, begins in d] for d in found if all(enough(x) for x, _ in d)])
        if "m" not in flags and part.startswith("^"):
            out[-1] = []
    return out


def quoted(text: str) -> str:
    """text as a regex of itself, in both dialects."""
    return "".join("\\" + c if not (c.isalnum() or c in " _") and ord(c) < 128 else c for c in text)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(jdk(pattern)))


def count_plain(text: Column, literal: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(jdk(pattern)))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(jdk(pattern)), F.lit(group))


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def blank(text: Column) -> Column:
    return ~F.regexp_like(text, F.lit(f"[^{SPACE}]"))


def rounded(value: Column, digits: int) -> Column:
    """Half up, for values that aren't negative."""
    p = float(10**digits)
    return F.floor(value * F.lit(p) + F.lit(0.5)) / F.lit(p)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value found once.  A column that a lambda reads may be put into its body by the optimizer and
    be found again for each element; a lambda's variable is not."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def one_digit(value: Column) -> Column:
    """A value that isn't negative with one digit after the point, as C's printf has it.

    Java's format rounds the shortest decimal half up, C the exact binary value half to even: of 2.25 and 0.35 it
    makes 2.2 and 0.3.  The fraction is taken as a whole number of 2 ** -57, which is exact from 2 ** -5 on; less is 0.0.
    """
    tenths = ((value - F.floor(value)) * F.lit(2.0**57)).cast("long") * 10
    digit, rest, half = F.shiftright(tenths, 57), tenths.bitwiseAND(F.lit((1 << 57) - 1)), F.lit(1 << 56)
    digit = digit + ((rest > half) | ((rest == half) & (digit % 2 == 1))).cast("long")
    return F.concat((F.floor(value) + F.when(digit == 10, 1).otherwise(0)).cast("string"), F.lit("."), (digit % 10).cast("string"))


def words(text: Column) -> Column:
    return find_all(text, WORD)


def count_words(text: Column) -> Column:
    return count(text, WORD)


def sentences(text: Column) -> Column:
    """Cut after closing marks and white space; trimmed, without empty ones."""
    cut = F.regexp_replace(text, F.lit(jdk(SENTENCE_END)), F.lit("$1\x01"))
    return F.filter(F.transform(F.split(cut, "\x01", -1), trimmed), lambda s: s != "")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, jdk(r"\n\s*\n"), -1), lambda p: ~blank(p))


def cyrillic_share(text: Column) -> Column:
    # by what is left of the text, not by an array of its letters
    many = lambda letter: F.length(text) - F.length(F.regexp_replace(text, letter + "+", ""))
    return let(many(r"\p{L}"), lambda n: F.when(n == 0, F.lit(0.0)).otherwise(many(f"[{CYRILLIC}]") / n))


def language(text: Column) -> Column:
    return F.when(cyrillic_share(text) >= 0.3, F.lit("ru")).otherwise(F.lit("en"))


def ends_with_any(word: Column, suffixes: list[str]) -> Column:
    return F.regexp_like(word, F.lit("(?:" + "|".join(suffixes) + r")\z"))


def norm_hash(text: Column) -> Column:
    """Twelve hex digits of the text with white space collapsed."""
    fields = F.filter(F.split(text, f"[{SPACE}]+", -1), lambda w: w != "")
    return F.substring(F.sha2(F.array_join(fields, " "), 256), 1, 12)


def rule_code(rule: Column) -> Column:
    return F.substring(F.sha2(rule, 256), 1, 6)


def excerpt(text: Column, line: Column) -> Column:
    """That line, trimmed, at most 90 characters; the first if there is no such line."""
    all_lines = lines(text)
    at = F.when((line >= 1) & (line <= F.size(all_lines)), line).otherwise(F.lit(1)).cast("int")
    s = trimmed(F.element_at(all_lines, at))
    return F.when(F.length(s) > 90, F.concat(F.substring(s, 1, 90), F.lit("..."))).otherwise(s)


def spread(lengths: Column) -> Column:
    """Coefficient of variation of whole numbers over all of them, three digits; exact sums, so any order gives it."""
    n, total = F.size(lengths), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    squares = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x * x)
    return F.when((n > 1) & (total > 0), rounded(F.sqrt((n * squares - total * total).cast("double")) / total, 3)).otherwise(F.lit(0.0))


def mean(lengths: Column, digits: int) -> Column:
    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(F.size(lengths) > 0, rounded(total / F.size(lengths), digits)).otherwise(F.lit(0.0))
