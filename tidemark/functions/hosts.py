"""Hosts of URLs in normal form: names in other scripts, numbers as IPv4 addresses, IPv6 literals.

A host is decoded, mapped to lower case and to ASCII (Punycode, label by label), and an address is written in
its one normal way. Mapped are upper case, full-width signs, the dots of other scripts and signs of no width;
a host with other signs that would have to be composed or replaced, or with what a host can't have, is null.
All functions take and give SQL text.
"""

from __future__ import annotations

from .sql import let, part, regex, without

# Punycode's parameters.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"

#: What a name may have in the end, and what keeps one from being mapped here: marks that combine, and forms of other signs.
_ALLOWED = r"^[!$&'()*+,\-.0-9;=_`a-z{}~\x22]+$"
_UNSURE = r"[\p{M}\p{Cn}\p{Co}\p{Cs}\p{Z}\x{fffd}\x{1e9e}\x{2100}-\x{214f}\x{2160}-\x{2188}\x{2460}-\x{24ff}\x{3200}-\x{33ff}\x{f900}-\x{faff}\x{fb00}-\x{fdff}\x{fe30}-\x{fe6f}\x{ff5f}-\x{ffef}\x{b2}\x{b3}\x{b9}\x{bc}-\x{be}\x{aa}\x{ba}\x{2070}-\x{209f}\x{1d400}-\x{1d7ff}]"
_NUMBER_AT_END = r"(?:^|\.)(?:\d+|0x[0-9a-f]*)\.?$"


def decoded_strictly(text: str) -> str:
    """``text`` with its percent signs decoded as UTF-8; null where one encodes nothing, or bytes that aren't UTF-8."""
    # What can't be decoded comes out as this sign: there may be as many of it as the text has, in either form.
    plain = f"try_url_decode(replace({text}, '+', '%2B'))"
    same = f"regexp_count(dec, '\ufffd') = regexp_count({text}, '(?i)\ufffd|%EF%BF%BD')"
    return f"if(contains({text}, '%'), {let(plain, 'dec', f'if({same}, dec, null)')}, {text})"


def _struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def _count(delta: str, bias: str) -> str:
    """``delta`` as a number of variable length whose digits' weights follow from ``bias``."""
    digit = lambda n: f"substring('{_DIGITS}', cast({n} AS int) + 1, 1)"
    more = _struct(q=f"(num.q - t) div ({BASE} - t)", text=f"concat(num.text, {digit(f't + (num.q - t) % ({BASE} - t)')})", done="false")
    last = _struct(q="num.q", text=f"concat(num.text, {digit('num.q')})", done="true")
    step = let(f"greatest({T_MIN}, least({T_MAX}, place - {bias}))", "t", f"if(num.q >= t, {more}, {last})")
    return f"aggregate(sequence({BASE}, {BASE * 14}, {BASE}), {_struct(q=delta, text=chr(39) * 2, done='false')}, (num, place) -> if(num.done, num, {step}), num -> num.text)"


def _next_bias(delta: str, handled: str, first: str) -> str:
    limit = (BASE - T_MIN) * T_MAX // 2
    halved = f"aggregate(sequence(1, 7), {_struct(d=f'small + small div ({handled} + 1)', k='0L')}, (adapt, turn) -> if(adapt.d > {limit}, {_struct(d=f'adapt.d div {BASE - T_MIN}', k=f'adapt.k + {BASE}')}, adapt), adapt -> adapt.k + ({BASE - T_MIN + 1} * adapt.d) div (adapt.d + {SKEW}))"
    return let(f"{delta} div if({first}, {DAMP}, 2)", "small", halved)


def punycode(label: str) -> str:
    """A label as Punycode, without the prefix."""
    plain = f"filter(codes, code -> code < {FIRST_CODE})"
    start = _struct(next=f"{FIRST_CODE}L", delta="0L", bias=f"{FIRST_BIAS}L", handled=f"cast(size({plain}) AS bigint)", text=f"concat(array_join(transform({plain}, code -> char(code)), ''), if(size({plain}) > 0, '-', ''))")
    put = _struct(next="one.next", delta="0L", bias=_next_bias("one.delta", "one.handled", f"one.handled = size({plain})"), handled="one.handled + 1", text=f"concat(one.text, {_count('one.delta', 'one.bias')})")
    passed = _struct(next="one.next", delta="one.delta + if(code < wanted, 1, 0)", bias="one.bias", handled="one.handled", text="one.text")
    begun = _struct(next="every.next", delta="every.delta + (wanted - every.next) * (every.handled + 1)", bias="every.bias", handled="every.handled", text="every.text")
    after = _struct(next="wanted + 1", delta="done.delta + 1", bias="done.bias", handled="done.handled", text="done.text")
    each = let(f"aggregate(codes, {begun}, (one, code) -> if(code = wanted, {put}, {passed}))", "done", after)
    encoded = f"aggregate(array_sort(array_distinct(filter(codes, code -> code >= {FIRST_CODE}))), {start}, (every, wanted) -> {each}, every -> every.text)"
    return let(f"transform(split({label}, ''), sign -> cast(ascii(sign) AS bigint))", "codes", encoded)


def _mapped(host: str) -> str:
    """Names of other scripts in lower case, with ASCII's own signs for full-width ones; null where more would have to be mapped."""
    letters = [c for c in range(0x21, 0x7F) if chr(c) not in "'\\"]
    wide = "".join(chr(c + 0xFEE0) for c in letters) + "。｡Σ"
    thin = "".join(map(chr, letters)) + "..σ"
    return let(f"lower(translate({without(host, r'[\x{ad}\x{200b}\x{2060}\x{feff}]')}, r'{wide}', r'{thin}'))", "narrow", f"if(narrow rlike {regex(_UNSURE)}, null, narrow)")


def _ascii(host: str) -> str:
    return f"array_join(transform(split({host}, {regex(r'\.')}), label -> if(label rlike {regex(r'^[\x00-\x7f]*$')}, label, concat('xn--', {punycode('label')}))), '.')"


def _ipv4(host: str) -> str:
    """One to four decimal, octal or hexadecimal numbers as an address, of which the last fills what is left; else null."""
    digits = lambda pattern, base: f"try_cast(cast(conv({part('p', pattern, 1)}, {base}, 10) AS decimal(20, 0)) AS bigint)"
    number = f"CASE WHEN p rlike {regex('^0x[0-9a-f]{0,15}$')} THEN coalesce({digits('^0x([0-9a-f]+)$', 16)}, 0L) WHEN p rlike {regex('^0[0-7]{0,20}$')} THEN {digits('^([0-7]+)$', 8)} WHEN p rlike {regex('^[1-9][0-9]{0,17}$')} THEN {digits('^([0-9]+)$', 10)} END"
    whole = "aggregate(sequence(1, size(n)), 0L, (acc, i) -> acc + if(i = size(n), element_at(n, -1), element_at(n, i) * element_at(array(16777216L, 65536L, 256L, 1L), i)))"
    quad = "concat_ws('.', " + ", ".join(f"cast(shiftrightunsigned(v, {8 * k}) % 256 AS string)" for k in (3, 2, 1, 0)) + ")"
    good = "NOT exists(n, x -> x IS NULL) AND NOT exists(slice(n, 1, size(n) - 1), x -> x > 255) AND element_at(n, -1) < element_at(array(4294967296L, 16777216L, 65536L, 256L), size(n))"
    return let(f"split({without(host, r'\.$')}, {regex(r'\.')})", "ps", f"if(size(ps) <= 4, {let(f'transform(ps, p -> {number})', 'n', f'if({good}, {let(whole, "v", quad)}, null)')}, null)")


def _ipv6(inside: str) -> str:
    """Eight groups, the first of the longest runs of zeros as ::, in brackets; null where it is no address."""
    byte = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    tail = r"^(.*:)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$"
    group = lambda i: f"lower(hex(cast(element_at(v, {i}) AS bigint) * 256 + cast(element_at(v, {i + 1}) AS bigint)))"
    quad = let(f"split({part('text', tail, 2)}, {regex(r'\.')})", "v", f"concat({part('text', tail, 1)}, {group(1)}, ':', {group(3)})")
    plain = let(inside, "text", f"if(text rlike {regex(rf'^.*:{byte}(?:\.{byte}){{3}}$')}, {quad}, text)")
    groups = lambda text: f"if({text} = '', cast(array() AS array<string>), split({text}, ':'))"
    left, right = groups("halves[0]"), groups("coalesce(get(halves, 1), '')")
    missing = f"(8 - size({left}) - size({right}))"
    good = f"size(halves) <= 2 AND if(size(halves) = 2, {missing} >= 1, {missing} = 0)"
    whole = f"concat({left}, array_repeat('0', greatest({missing}, 0)), {right})"
    filled = f"if({good}, {let(whole, 'g', f'if(exists(g, x -> NOT x rlike {regex("^[0-9a-f]{1,4}$")}), null, transform(g, x -> {without("x", "^0+(?=.)")}))')}, null)"
    run = lambda n: rf"(?:^|:)0(?::0){{{n - 1}}}(?::|$)"
    cases = " ".join(f"WHEN short rlike {regex(run(n))} THEN {without('short', rf'^(.*?){run(n)}(.*)$', '$1::$2')}" for n in range(8, 1, -1))
    shortened = let("array_join(full, ':')", "short", f"concat('[', CASE {cases} ELSE short END, ']')")
    return let(plain, "tidy", let("split(tidy, '::')", "halves", let(filled, "full", f"if(full IS NULL, null, {shortened})")))


def normal_host(host: str) -> str:
    """A host (the name of a value, without port) in normal form, or null."""
    named = let(f"if(h rlike {regex(r'^[\x00-\x7f]*$')}, lower(h), {let(_mapped('h'), 'mapped', f'if(mapped IS NULL, null, {_ascii("mapped")})')})", "a", f"CASE WHEN a rlike {regex(_NUMBER_AT_END)} THEN {_ipv4('a')} WHEN a rlike {regex(_ALLOWED)} THEN a END")
    return f"""CASE WHEN {host} rlike {regex(r'^(?:[A-Za-z0-9-]+\.)*[A-Za-z-][A-Za-z0-9-]*$')} AND NOT {host} rlike {regex(r'(?i)(?:^|\.)0x[0-9a-f]*$')} THEN lower({host})
      WHEN {host} rlike {regex(r'^\[.*\]$')} THEN {_ipv6(f'lower({without(host, r"^\[|\]$")})')} ELSE {let(decoded_strictly(host), 'h', named)} END"""
