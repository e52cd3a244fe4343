"""Rules, labels and other fixed values, in the regex dialect of the JVM.

Character classes are spelled out, because the JVM's shorthand classes differ from the intended Unicode meaning: a word character is a
letter, a number or an underscore, a digit is any decimal digit, and white space is the set below.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

SPACE = r"\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"
S, D = f"[{SPACE}]", DIGIT
START = f"(?<![{WORD}])"
#: Between a word character and something else, either way.
EDGE = f"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

#: Entity types in their order.
ENTITY_TYPES = ("PERSON", "PHONE", "EMAIL", "ADDRESS", "ORG", "CONTRACT_ID", "PASSPORT", "TAX_ID", "CARD", "API_KEY", "OTHER_SECRET")
#: Which type a value gets that several rules find; others come after these.
PRIORITY = {"API_KEY": 0, "CARD": 1, "PASSPORT": 2, "TAX_ID": 3}
LAST_PRIORITY = 10


@dataclass(frozen=True)
class Rule:
    type: str
    pattern: str
    group: int = 0
    #: A cheap pattern that every text with a match has.
    hint: str = r"\p{Nd}"


#: The rules, in the order in which their finds count as seen.
RULES = (
    Rule("EMAIL", f"(?iu)(?<![{WORD}.+-])[{WORD}.+-]+{S}*@{S}*[{WORD}-]+(?:{S}*\\.{S}*[{WORD}-]+)+", hint="@"),
    Rule("API_KEY", f"{EDGE}(?:sk-[{WORD}-]{{12,}}|gh[pousr]_[{WORD}]{{20,}}|AKIA[0-9A-Z]{{16}}){EDGE}", hint="sk-|gh[pousr]_|AKIA"),
    Rule("CARD", f"(?<!{D}){D}(?:[{SPACE}-]?{D}){{12,18}}(?!{D})"),
    Rule("PHONE", f"(?<!{D})(?:\\+?{D}[{D}{SPACE}().-]{{8,}}{D})(?!{D})"),
    Rule("CONTRACT_ID", f"(?iu){START}(?:договор|акт|agreement|contract|invoice|case|proposal){S}+([A-ZА-Я0-9][A-ZА-Я0-9-]{{4,}}){EDGE}", 1, "(?iu)договор|акт|agreement|contract|invoice|case|proposal"),
    Rule("OTHER_SECRET", f"(?iu){START}(?:код{S}+доступа|temporary{S}+phrase|access{S}+code|password|secret){S}+([A-Z0-9][A-Z0-9-]{{7,}}){EDGE}", 1, "(?iu)код|temporary|access|password|secret"),
    Rule("PASSPORT", f"(?iu){START}(?:паспорт|passport){S}*(?:№|no\\.?|number|серия)?{S}*({D}{{4}}{S}?{D}{{6}}){EDGE}", 1, "(?iu)паспорт|passport"),
    Rule("TAX_ID", f"(?iu){START}(?:инн|tax{S}*id|tin){S}*[:№#-]?{S}*({D}{{10}}|{D}{{12}}){EDGE}", 1, "(?iu)инн|tax|tin"),
)

#: Obfuscated marks of e-mail addresses and what they stand for.
MARKERS = (("at", "@"), ("dot", "."))
MARKED = f"(?iu)[\\[(]{S}*(?:at|dot){S}*[\\])]"

#: Tokens that stand for values.
TOKEN_PREFIX = "__PII_"
TOKEN = r"__PII_[A-F0-9]{8,32}_(?:[A-Z][A-Z_]*_)?\p{Nd}{4}__"
NONCE = r"^[A-F0-9]{8,32}$"

#: Verbs and objects of suspicious instructions, at most 80 characters apart, and the codes of their warnings.
TRUST = (
    ("possible_instruction_override", "ignore|disregard|forget|override|игнорир(?:уй|овать)|забудь|отмени", "instruction|prompt|system|правил|инструкц|промпт"),
    ("possible_tool_or_external_action_request", "run|execute|call|open|browse|send|upload|delete|запусти|выполни|вызови|отправь|загрузи|удали", "tool|command|shell|terminal|browser|email|file|инструмент|команд|терминал|браузер|письм|файл"),
    ("possible_secret_exfiltration_request", "reveal|print|return|send|exfiltrate|покажи|раскрой|выведи|верни|отправь", f"system prompt|secret|credential|api key|системн[{WORD}]* промпт|секрет|ключ|парол"),
)


def trust_pattern(verbs: str, objects: str, flags: str = "(?isu)") -> str:
    """Every verb ends and every object starts with a word character, so the boundary is a character that is none."""
    return f"{flags}(?:{verbs})[^{WORD}].{{0,79}}(?:{objects})"


def _runs() -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of the characters that canonicalization, one by one, leaves alone, and of those that it drops or changes."""
    kept: list[tuple[int, int]] = []
    changed: list[tuple[int, int]] = []
    start, last = 0, None
    for point in range(sys.maxunicode + 2):
        char = chr(point) if point <= sys.maxunicode and not 0xD800 <= point < 0xE000 else None
        now = char and (unicodedata.category(char) == "Cf" or unicodedata.normalize("NFKC", char) != char)
        if now != last:
            if last is not None:
                (changed if last else kept).append((start, point - 1))
            start, last = point, now
    return kept, changed


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


_KEPT, _CHANGED = _runs()
#: Texts that canonicalization may change. A character is first held against a few ranges that hold most of all text.
UNUSUAL = f"[[^{_class([(a, b) for a, b in _KEPT if a < 0x530 or b - a >= 100])}]&&[{_class(_CHANGED)}]]"

#: Limits of a request and of a file.
MAX_TEXT, MAX_TASK, MAX_EDITS, MAX_REVISION = 20_000, 4_000, 100, 1_000
MAX_FILE_BYTES = 5 * 1024 * 1024
SUFFIXES = (".txt", ".md", ".docx", ".pdf")
