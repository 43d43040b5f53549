"""Trying a pattern on short texts that make a backtracking engine go astray, by counting instead of by the clock.

Each of the four texts is a run of one unit and a character that ends it. A pattern is gone through piece by piece, and for every piece
two things are kept: in how many ways it reads the next n characters of a run, and how many steps it takes to go through all of these
ways. Ways are multiplied where pieces follow each other and added where they are alternatives, so the steps of the whole pattern are known
without taking them. Whether a single character, class or literal reads a text is asked of the engine that runs the patterns.

The expression is written as SQL text, which is parsed at once; from several thousand `Column` calls it would take seconds to build.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import count
from math import comb

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The run and the end of each text.
TRIAL_TEXTS = (("a" * 40, "!"), ("0" * 40, "X"), (" " * 40, "x"), ("ab" * 25, "!"))
#: More steps than this on one text are too many.
MAX_STEPS = 50_000_000
#: So many steps at most are really taken, to see whether the pattern finds something and stops.
_FEW_STEPS = 100_000

# Runs by the character that they start with; the last two are of one text, read from its first and from its second character.
_RUNS = (*(run for run, _ in TRIAL_TEXTS), ("ab" * 25)[1:] + "a")
_LONGEST = max(map(len, _RUNS))
_PAIR = len(TRIAL_TEXTS) - 1
_SIZES = [len(run) + 1 for run in _RUNS]

_CLASS = r"\[(?:[^\[\]\\]|\\.)*+\]"
for _ in range(3):
    _CLASS = rf"\[(?:[^\[\]\\]|\\.|{_CLASS})*+\]"
_ESCAPE = r"\\(?:[pPxN]\{[^}]*+\}|k<[^>]*+>|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|[pP].|c.|0[0-3]?[0-7]{1,2}|[1-9][0-9]*+|.)"
_GROUP = r"\((?:\?(?:<[=!]|[:=!>]|<[A-Za-z]\w*+>|[A-Za-z-]*+[:)]))?+"
_QUANTIFIER = r"(?:[*+?]|\{\d+(?:,\d*)?\})[+?]?+"
_LITERAL = r"(?:[A-Za-z0-9 _](?![*+?{]))++"
#: A piece of a pattern, and the quantifier behind it.
_PIECE = rf"(?s)({_GROUP}|\||(?:\)|\\Q.*?(?:\\E|\z)|{_ESCAPE}|{_CLASS}|{_LITERAL}|.))({_QUANTIFIER})?+"
_REPEAT = r"[*+]|\{\d+,"
_FLAGS = r"(?<!\\)\(\?([idmsuU]+)(?:-[a-zA-Z]*)?[:)]"
#: Pieces that may hold signs which are none of a quantifier.
_SIGNLESS = rf"(?s)\\Q.*?(?:\\E|\z)|{_ESCAPE}|{_CLASS}|(?<=\()\?(?:<[=!]|[:=!>]|<[A-Za-z]\w*+>)"

_names = count()


def _over(function: str, *values: str, do: Callable[..., str], arity: int = 1) -> str:
    """A higher-order function of SQL; the body is made from the names of its variables."""
    names = [f"v{next(_names)}" for _ in range(arity)]
    variables = names[0] if arity == 1 else f"({', '.join(names)})"
    return f"{function}({', '.join(values)}, {variables} -> {do(*names)})"


def _let(value: str, do: Callable[[str], str]) -> str:
    """The body with the value in it, worked out once."""
    return f"get({_over('transform', f'array({value})', do=do)}, 0)"


def _if(test: str, then: str, otherwise: str) -> str:
    return f"if({test}, {then}, {otherwise})"


def _text(text: str) -> str:
    return f"r'{text}'"


def _list(values) -> str:
    return f"array({', '.join(map(str, values))})"


def _each(numbers: Callable[[int], str]) -> str:
    """Numbers for each run, by an expression of how many a run has."""
    return f"cast({_list(map(numbers, _SIZES))} as array<array<double>>)"


def _pair(ways: str, steps: str) -> str:
    return f"named_struct('ways', {ways}, 'steps', {steps})"


_STARTS = _list(range(len(_RUNS)))
_NONE = "cast(array() as array<double>)"
_UNREAD, _EMPTY, _ANY = (_each(lambda _, w=ways: w) for ways in ("array()", "array(1)", "array(0, 1)"))
_NO_STEPS, _ONE_STEP = (_each(lambda size, n=n: f"array_repeat({n}, {size})") for n in (0, 1))
_NOTHING, _NEVER = _pair(_EMPTY, _NO_STEPS), _pair(_UNREAD, _NO_STEPS)


def _after(start: str, n: str) -> str:
    """The run that is left of one after n characters."""
    return f"if({start} < {_PAIR}, {start}, {_PAIR} + ({start} - {_PAIR} + {n}) % 2)"


def _monomial(n: str) -> str:
    """One way, which reads n characters."""
    return f"concat(array_repeat(0D, {n}), array(1D))"


def _terms(numbers: str) -> str:
    """The numbers that are not 0, with their places."""
    placed = _over("transform", numbers, do=lambda v, n: f"named_struct('v', {v}, 'n', {n})", arity=2)
    return _over("filter", placed, do=lambda t: f"{t}.v != 0")


def _add(a: str, b: str) -> str:
    return _over("zip_with", a, b, do=lambda x, y: f"coalesce({x}, 0D) + coalesce({y}, 0D)", arity=2)


def _added(a: str, b: str) -> str:
    return _over("zip_with", a, b, do=_add, arity=2)


def _times(ways: str, then: str) -> str:
    """For each run: the sum over n of the ways to read n characters, times what there is of the other from there on."""

    def of(start: str) -> str:
        size = f"get({_list(_SIZES)}, {start})"

        def term(total: str, t: str) -> str:
            rest = _over("transform", f"get({then}, {_after(start, f'{t}.n')})", do=lambda v: f"{v} * {t}.v")
            return f"slice({_add(total, f'concat(array_repeat(0D, {t}.n), {rest})')}, 1, {size})"

        def sums(numbers: str, times: str) -> str:
            """What `term` comes to where the other is the same all along."""
            filled = f"concat({numbers}, array_repeat(0D, {size} - size({numbers})))"
            more = lambda so_far, v: f"concat({so_far}, array(coalesce(get({so_far}, size({so_far}) - 1), 0D) + {v} * {times}))"
            return _over("aggregate", filled, _NONE, do=more, arity=2)

        def by_what_follows(next_: str) -> str:
            first = f"get({next_}.here, 0)"
            same = " and ".join(f"size({x}) = {size} and array_min({x}) = {first} and array_max({x}) = {first}" for x in (f"{next_}.here", f"{next_}.there"))
            all_ = _over("aggregate", _terms(f"{next_}.ways"), _NONE, do=term, arity=2)
            nothing = f"size({next_}.ways) = 0 or size({next_}.here) + size({next_}.there) = 0"
            return f"case when {nothing} then {_NONE} when {same} then {sums(f'{next_}.ways', first)} else {all_} end"

        here, there = f"get({then}, {start})", f"get({then}, {_after(start, '1')})"
        return _let(f"named_struct('ways', slice(get({ways}, {start}), 1, {size}), 'here', {here}, 'there', {there})", by_what_follows)

    return _over("transform", _STARTS, do=of)


def _then(a: str, b: str) -> str:
    both = _added(f"{a}.steps", _times(f"{a}.ways", f"{b}.steps"))
    return _pair(_times(f"{a}.ways", f"{b}.ways"), both)


def _or(a: str, b: str) -> str:
    return _pair(_added(f"{a}.ways", f"{b}.ways"), _added(f"{a}.steps", f"{b}.steps"))


def _again(piece: str) -> str:
    """The piece any number of times; a round that reads nothing is none."""

    def one_more(ways: str, n: str) -> str:
        def of(start: str) -> str:
            rounds = _over("filter", _terms(f"get({piece}.ways, {start})"), do=lambda t: f"{t}.n between 1 and {n}")
            total = _over(
                "aggregate", rounds, "0D", arity=2,
                do=lambda sum_, t: f"{sum_} + {t}.v * get(get({ways}, {_after(start, f'{t}.n')}), {n} - {t}.n)",
            )
            return f"concat(get({ways}, {start}), array({total}))"

        return _over("transform", _STARTS, do=of)

    rounds = _over("aggregate", f"sequence(1, {_LONGEST})", _EMPTY, do=one_more, arity=2)
    return _let(rounds, lambda ways: _pair(ways, _times(ways, _added(f"{piece}.steps", _ONE_STEP))))


def _steps_to_first(piece: str) -> str:
    """Where a piece reads something it does so at once; where it can't, all is gone through."""

    def of(ways: str, steps: str) -> str:
        at_once = _over("transform", steps, do=lambda _, n: f"cast({n} + 1 as double)", arity=2)
        return _if(_over("exists", ways, do=lambda v: f"{v} != 0"), at_once, steps)

    return _over("zip_with", f"{piece}.ways", f"{piece}.steps", do=of, arity=2)


def _first_only(piece: str) -> str:
    """A possessive piece, an atomic group: once it has read its longest, it is not tried in another way."""

    def longest(ways: str) -> str:
        places = _over("transform", _terms(ways), do=lambda t: f"{t}.n")
        return _let(f"array_max({places})", lambda n: _if(f"{n} is null", _NONE, _monomial(n)))

    return _pair(_over("transform", f"{piece}.ways", do=longest), _steps_to_first(piece))


def _repeated(piece: str, quantifier: str) -> str:
    """The piece as often as its quantifier says. Rounds beyond the longest text read nothing more."""
    sign = f"substring({quantifier}, 1, 1)"

    def number(group: int) -> str:
        digits = f"regexp_extract({quantifier}, {_text(r'\{(\d+)(,?)(\d*)')}, {group})"
        return f"if({digits} = '', null, least(coalesce(try_cast({digits} as int), {_LONGEST + 1}), {_LONGEST + 1}))"

    least = f"case {sign} when '{{' then {number(1)} when '+' then 1 else 0 end"
    most = f"case when {sign} = '?' then 1 when {sign} != '{{' then null when contains({quantifier}, ',') then {number(3)} else {number(1)} end"

    def rounds(bounds: str) -> str:
        last = _if(f"{bounds}.most is null", _again(piece), _NOTHING)
        optional = f"array_repeat(true, coalesce({bounds}.most - {bounds}.least, 0))"

        def one_more(rest: str, may: str) -> str:
            return _let(_then(piece, rest), lambda r: _if(may, _or(_NOTHING, r), r))

        return _over("aggregate", f"concat({optional}, array_repeat(false, {bounds}.least))", last, do=one_more, arity=2)

    whole = _let(f"named_struct('least', {least}, 'most', {most})", rounds)
    possessive = f"length({quantifier}) > 1 and endswith({quantifier}, '+')"
    return _if(f"coalesce({quantifier}, '') = ''", piece, _let(whole, lambda w: _if(possessive, _first_only(w), w)))


def _found(regex: str, text: str) -> str:
    known = f"try_reflect('java.util.regex.Pattern', 'compile', {regex}) is not null"
    return _if(known, f"regexp_like({text}, {regex})", "false")


def _leaf(text: str, flags: str, start: str) -> str:
    """A piece without pieces in it. A run has no border, start or end but at its start, before anything is read."""
    quoted = f"length(regexp_replace({text}, {_text(r'^\\Q|\\E$')}, ''))"
    size = f"case when startswith({text}, {_text(r'\Q')}) then {quoted} when {text} rlike {_text(f'^{_LITERAL}$')} then length({text}) else 1 end"
    regex = f"concat({_text(r'\A(?:')}, {flags}, {text}, {_text(r')\z')})"

    def reads(asked: str) -> str:
        read = lambda run: _if(_found(f"{asked}.regex", f"substring({run}, 1, {asked}.size)"), _monomial(f"{asked}.size"), _NONE)
        return _over("transform", _list(map(_text, _RUNS)), do=read)

    ways = f"""case when {text} in ('$', {_text(r'\z')}, {_text(r'\Z')}) then {_UNREAD}
        when {text} in ('^', {_text(r'\A')}, {_text(r'\G')}, {_text(r'\b')}) then if({start}, {_EMPTY}, {_UNREAD})
        when {text} = {_text(r'\B')} or startswith({text}, '(?') then {_EMPTY}
        when {text} rlike {_text(r'^\\(?:[1-9]|k<)')} then {_ANY}
        else {_let(f"named_struct('size', {size}, 'regex', {regex})", reads)} end"""
    return _pair(ways, _ONE_STEP)


def _closed(frame: str) -> str:
    """The group whose end is met."""
    look = f"{frame}.open in ('(?=', '(?!', '(?<=', '(?<!')"
    return _let(
        _or(f"{frame}.others", f"{frame}.so_far"),
        lambda group: _if(look, _pair(_EMPTY, _steps_to_first(group)), _if(f"{frame}.open = '(?>'", _first_only(group), group)),
    )


def _frame(open_: str, begin: str, reached: str, others: str = _NEVER, so_far: str = _NOTHING) -> str:
    """A group that is open: where its last alternative begins, which runs get to it, its other alternatives, its last one so far."""
    return f"named_struct('open', {open_}, 'begin', {begin}, 'reached', {reached}, 'others', {others}, 'so_far', {so_far})"


def _alternatives(pattern: str) -> str:
    """The alternatives of a sound pattern and of its groups, with the steps that each takes over each run that gets to it."""
    texts, quantifiers = (f"regexp_extract_all({pattern}, {_text(_PIECE)}, {group})" for group in (1, 2))
    pieces = _over("zip_with", texts, quantifiers, do=lambda t, q: f"named_struct('text', {t}, 'quantifier', coalesce({q}, ''))", arity=2)
    named = _over("transform", f"regexp_extract_all({pattern}, {_text(_FLAGS)}, 1)", do=lambda f: f"concat('(?', {f}, ')')")

    def read(flags: str) -> str:
        def with_last(now: str, frame: str) -> str:
            text = f"concat({flags}, substring({now}.text, {frame}.begin))"
            steps = _over("zip_with", f"{frame}.reached", f"{frame}.so_far.steps", do=lambda r, c: _if(r, c, _NONE), arity=2)
            return f"concat({now}.done, array(named_struct('text', {text}, 'steps', {steps})))"

        def step(now: str, piece: str) -> str:
            text, frames, closes = f"{piece}.text", f"{now}.frames", f"{piece}.text = ')'"
            last, below = f"get({frames}, size({frames}) - 1)", f"slice({frames}, 1, greatest(size({frames}) - 1, 0))"

            def with_frames(frames: str, done: str = f"{now}.done") -> str:
                return f"named_struct('frames', {frames}, 'text', concat({now}.text, {text}, {piece}.quantifier), 'done', {done})"

            def opened(top: str) -> str:
                gets = lambda r, ways: f"{r} and {_over('exists', ways, do=lambda v: f'{v} != 0')}"
                reached = _over("zip_with", f"{top}.reached", f"{top}.so_far.ways", do=gets, arity=2)
                return with_frames(f"concat({frames}, array({_frame(text, f'length({now}.text) + length({text}) + 1', reached)}))")

            def parted(top: str) -> str:
                others = _or(f"{top}.others", f"{top}.so_far")
                fresh = _frame(f"{top}.open", f"length({now}.text) + 2", f"{top}.reached", others)
                return with_frames(f"concat({below}, array({fresh}))", with_last(now, top))

            def advanced(outer: str) -> str:
                def on(top: str) -> str:
                    start = f"{top}.so_far.ways = {_EMPTY} and forall({top}.reached, r -> r)"
                    found = _if(closes, _let(last, _closed), _leaf(text, flags, start))
                    longer = _let(found, lambda p: _let(_repeated(p, f"{piece}.quantifier"), lambda r: _then(f"{top}.so_far", r)))
                    wider = _frame(f"{top}.open", f"{top}.begin", f"{top}.reached", f"{top}.others", longer)
                    return f"concat(slice({outer}, 1, greatest(size({outer}) - 1, 0)), array({wider}))"

                return _let(f"get({outer}, size({outer}) - 1)", on)

            opens = f"startswith({text}, '(') and not {text} rlike {_text(r'^\(\?[A-Za-z-]*\)')}"
            further = with_frames(_let(_if(closes, below, frames), advanced), _if(closes, _let(last, lambda top: with_last(now, top)), f"{now}.done"))
            return f"case when {opens} then {_let(last, opened)} when {text} = '|' then {_let(last, parted)} else {further} end"

        whole = f"array({_frame("''", '1', f'array_repeat(true, {len(_RUNS)})')})"
        begin = f"named_struct('frames', {whole}, 'text', '', 'done', cast(array() as array<struct<text:string,steps:array<array<double>>>>))"
        end = _let_lambda(lambda now: _let(f"get({now}.frames, 0)", lambda top: with_last(now, top)))
        return _over("aggregate", pieces, begin, do=step, arity=2)[:-1] + f", {end})"

    return _let(f"array_join({named}, '')", read)


def _let_lambda(do: Callable[[str], str]) -> str:
    name = f"v{next(_names)}"
    return f"{name} -> {do(name)}"


@cache
def _too_slow() -> str:
    """Whether a search of one of the trial texts with the pattern `{pattern}` takes too many steps, as SQL."""

    def fails(alternative: str, start: str) -> str:
        def of(steps: str) -> str:
            few = _over("filter", steps, do=lambda s: f"{s} <= {_FEW_STEPS}")
            text = f"concat(substring(get({_list(map(_text, _RUNS))}, {start}), 1, size({few}) - 1), get({_list(_text(e) for _, e in TRIAL_TEXTS)}, {start}))"
            many = _over("aggregate", steps, "0D", do=lambda total, s: f"{total} + {s}", arity=2)
            return f"{many} > {MAX_STEPS} and not {_found(f"concat({_text(r'\A(?:')}, {alternative}.text, ')')", text)}"

        return _let(f"get({alternative}.steps, {start})", of)

    def slow(pattern: str) -> str:
        tried = _list(range(len(TRIAL_TEXTS)))
        any_ = _over("exists", _alternatives(pattern), do=lambda a: _over("exists", tried, do=lambda start: fails(a, start)))
        return _if(f"coalesce({_settled(pattern)}, true)", "false", f"coalesce({any_}, false)")

    return _let("{pattern}", slow)


def _settled(pattern: str) -> str:
    """Whether the form alone tells that a pattern takes few steps.

    Without repeated groups, the repeats share at most the text among them, an optional piece doubles the ways at most, and so does an alternative.
    """

    def by_signs(signs: str) -> str:
        def number(sign: str) -> str:
            return f"size(regexp_extract_all({signs}, {_text(sign)}, 0))"

        shared = _list(comb(_LONGEST + 1 + n, n + 1) for n in range(6))
        steps = f"3D * length({pattern}) * pow(2, {number('[?|]')}) * get({shared}, {number(_REPEAT)})"
        return f"not {signs} rlike {_text(r'\)(?:[*+]|\{)')} and coalesce({steps} < {MAX_STEPS}, false)"

    plain = f"regexp_replace({pattern}, {_text(_SIGNLESS)}, '.')"
    return _let(f"regexp_replace({plain}, {_text(r'(?<=[*+?}])[+?]')}, '')", by_signs)


def too_slow(patterns: str) -> Column:
    """Which of a column's array of sound patterns take too many steps to search one of the trial texts with; null is not tried.

    A search starts at every character, and goes through all ways if it fails. It does not if the pattern finds something at once in a run
    that takes few steps, which is searched to see.
    """
    name = f"v{next(_names)}"
    return F.expr(f"transform({patterns}, {name} -> {_too_slow().replace('{pattern}', name)})")
