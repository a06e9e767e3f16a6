"""Column functions that turn a raw command line into normalised text, tokens and a root executable.

Everything here is a Catalyst expression: it runs in the JVM, works on batch and streaming frames, and needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

DEFAULT_PASSES = 15


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _apply_rules(text: Column, rules: Sequence[P.Rule]) -> Column:
    for rule in rules:
        text = F.regexp_replace(text, rule.pattern, rule.replacement)
    return text


def normalize(text: Column, extra_rules: Sequence[P.Rule] = (), max_passes: int = DEFAULT_PASSES) -> Column:
    """Replace volatile values by placeholders; null becomes the empty string.

    One pass over the built-in rules is already a fixed point (no placeholder can complete a match of another
    rule), so they are a plain chain of replacements.  With extra rules nothing is known about the fixed point:
    the whole rule list is repeated until the text stops changing, at most ``max_passes`` times.
    """
    text = F.coalesce(text, F.lit(""))
    if max_passes < 1:
        return text
    if not extra_rules:
        return _apply_rules(text, P.BUILTIN_RULES)
    rules = (*P.BUILTIN_RULES, *extra_rules)
    return _run_passes(text, rules, max_passes)["text"]


def is_unstable(text: Column, extra_rules: Sequence[P.Rule], max_passes: int = DEFAULT_PASSES) -> Column:
    """True where :func:`normalize` used up its passes without seeing the text stand still."""
    rules = (*P.BUILTIN_RULES, *extra_rules)
    return ~_run_passes(F.coalesce(text, F.lit("")), rules, max_passes)["stable"]


def _run_passes(text: Column, rules: Sequence[P.Rule], max_passes: int) -> Column:
    def one_pass(state: Column, _: Column) -> Column:
        return F.when(state["stable"], state).otherwise(
            let(
                _apply_rules(state["text"], rules),
                lambda after: F.struct(after.alias("text"), (after == state["text"]).alias("stable")),
            )
        )

    start = F.struct(text.alias("text"), F.lit(False).alias("stable"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(max_passes)), start, one_pass)


def strip_quotes(text: Column) -> Column:
    """Drop single and double quotes at both ends."""
    return F.trim(text, F.lit("\"'"))


def tokenize(text: Column) -> Column:
    """Array of lower-cased tokens in order of appearance; null becomes the empty array."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(P.TOKEN_PATTERN), F.lit(0))
    return F.transform(found, strip_quotes)


def token_count(tokens: Column) -> Column:
    return F.size(tokens)


def shell_parts(text: Column) -> Column:
    """Split as a shell would, quotes kept; with an unclosed quote, split at white space instead."""

    def accept(parts: Column) -> Column:
        unclosed = F.array_contains(parts, '"') | F.array_contains(parts, "'")
        return F.when(unclosed, words(text)).otherwise(parts)

    return let(F.regexp_extract_all(text, F.lit(P.SHELL_PART), F.lit(0)), accept)


def words(text: Column) -> Column:
    """Maximal runs of non-blank characters, case kept."""
    return F.regexp_extract_all(text, F.lit(P.NON_SPACE_RUN), F.lit(0))


def first_word(text: Column) -> Column:
    """The first run of non-blank characters, null if there is none."""
    return F.nullif(F.regexp_extract(text, P.NON_SPACE_RUN, 0), F.lit(""))


def windows_basename(path: Column) -> Column:
    """Last component of a Windows path; slashes and backslashes both separate."""
    return F.regexp_extract(path, P.WINDOWS_BASENAME, 1)


def root_executable(text: Column) -> Column:
    """Base name of the program a command line starts, case kept; empty for null or blank input.

    The program is everything up to the first part with an executable ending (which mends unquoted paths with
    blanks), or the first part where none has one.
    """

    def pick(parts: Column) -> Column:
        ends_program = F.transform(parts, lambda part: part.rlike(P.EXECUTABLE_PART))
        return let(
            F.array_position(ends_program, True),
            lambda position: F.when(
                position > 0, F.array_join(F.slice(parts, F.lit(1), position.cast("int")), " ")
            ).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit(""))),
        )

    program = let(shell_parts(F.coalesce(text, F.lit(""))), pick)
    return windows_basename(F.trim(program, F.lit('"')))


def capitalize(text: Column) -> Column:
    """First letter upper case, everything after it lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def executable_title(path: Column) -> Column:
    """``c:\\\\x\\\\tool.exe`` -> ``Tool``: last backslash component, ``.exe`` removed, capitalised."""
    return capitalize(F.replace(F.element_at(F.split(path, r"\\"), -1), F.lit(".exe"), F.lit("")))


def join_words(words_: Column) -> Column:
    return F.array_join(words_, ", ")


def extract_command_line(message: Column) -> Column:
    """The ``CommandLine:`` field of an event message, null if there is none.

    Line ends may be real or already spelled as backslash and n; a field that is not closed by a line end does not count.
    """
    return F.get(command_line_fields(message), F.lit(0))


def command_line_fields(message: Column) -> Column:
    """All ``CommandLine:`` fields of an event message as an array."""
    spelled = F.when(message.contains("\\n"), message).otherwise(
        F.replace(F.replace(message, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit(""))
    )
    # regexp_extract gives '' both for an empty field and for no field; the array form tells them apart.
    return F.regexp_extract_all(spelled, F.lit(P.MESSAGE_COMMAND_LINE), F.lit(1))
