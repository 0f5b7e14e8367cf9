"""Defective pairs of a prompt and its response, each with one defect type.

The tests, in this order, so that a pair has at most one defect:

- ``truncated``: the response's text was cut, judged by the pushdown parser and the prefix join of
  ``truncation`` over all responses.
- ``empty``: null, blank, or only a mark that stands for no answer.
- ``copy``: greedy string tiling covers nearly all words of the response and of the prompt, however
  often it is given back, and the response adds no value of its own. Bare values are never copies.
- ``refusal``: a grammar of refusals, sequences of slots (agent, negation, act, duty, reason) in
  several languages, in a response that states no value of its own.
- ``other_language``: the response's script, or letter n-grams by a margin, belong to another language
  than the prompt's.

Where a response has an answer tag, the response is what the tag holds. Defined cases: a null
prompt can be neither copied nor differ in language; repeated rows are judged alike; ties between
languages count for the prompt's language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import structure as S
from sparkloom.llm.language import differs
from sparkloom.llm.truncation import copies, cut_texts, has_letters, instructions, may_be_open, message_texts, task_prompts
from sparkloom.session import cut_lineage

# Marks of no answer and the words of the refusal grammar.
NO_ANSWER = frozenset(
    "na|none|null|nil|nan|noanswer|noresponse|nothing|undefined|empty|blank|tbd|unknown|notavailable|notapplicable|noreply|noanswergiven|keineantwort|keine|leer|sansréponse|pasderéponse|aucune|aucuneréponse|sinrespuesta|ninguna|ninguno|vacío|nessunarisposta|nessuna|geenantwoord|brakodpowiedzi".split("|")
)
#: The grammar of refusals: words that fill a slot, by language, and sequences of slots. A slot in brackets may be missing.
SLOTS = {
    "en": {
        "agent": "i|we|i'm|i am|we're|we are|this assistant|this model|the assistant|the tutor|i have|we have|myself",
        "start": r"^|[.!?,:;…-]\s*|\b(?:sorry|but|so|unfortunately|nope|no|however|apologies)\s+",
        "how": "really|simply|just|also|unfortunately|currently|respectfully|politely|sadly|still",
        "negation": "can't|cannot|can not|cant|couldn't|could not|won't|will not|shan't|shall not|don't|do not|am not able to|are not able to|not able to|unable to|am not going to|not going to|not willing to|unwilling to|not in a position to|not allowed to|not permitted to|must not|may not|not supposed to|would rather not|'d rather not|prefer not to|would prefer not to|refuse to|decline to|have to refuse to|am not here to",
        "being": "be|wish to|want to|feel comfortable|comfortably|possibly|even|be able to",
        "act": r"(?:help|assist|answer|solv|do|work|comput|calculat|provid|tak|complet|process|handl|discuss|support|respond|reply|continu|fulfil|perform|give|offer|share|engag|carry|say|go|tell)\w*",
        "duty": "must|have to|need to|will|would like to|'ll|am going to|should|shall|am forced to|am afraid i must",
        "decline": r"declin\w*|refus\w*|pass on|abstain|turn (?:this|that|it) down|skip (?:this|that|it)",
        "impossible": "(?:is |it's |was )?(?:not possible|impossible|out of the question) for (?:me|us) to",
        "beyond": r"(?:beyond|outside|outside of|not part of|not within|out of) (?:of )?(?:my|our|what (?:i|we)\b)(?: \w+)?",
        "lack": "(?:don't|do not|lack|without) (?:have )?(?:the )?(?:ability|permission|means|capability|capacity|authority|tools)",
        "kind": r"(?:requests?|questions?|problems?|tasks?|exercises?) (?:of|like) (?:this|that|these)(?: (?:sort|kind|type|nature|one))?",
        "unsupported": "(?:is|are) not (?:supported|allowed|permitted|answered|handled|accepted|possible here)",
        "rules": r"(?:my|our|the|these) (?:\w+ )?(?:instructions|rules|guidelines|policy|policies|settings|restrictions)",
        "forbid": r"(?:do not|don't|does not|doesn't|will not|won't) (?:allow|permit|let)|forbid\w*|prohibit\w*|prevent\w*|keep me from",
        "outcome": "(?:no|not any) (?:solution|answer|help|reply|response|result)|(?:the )?(?:reply|answer|response|solution|result)",
        "withheld": "(?:will|can|could|may) (?:not )?be (?:given|provided|offered|shared|shown)(?: here)?|(?:was|is|has been|were|stays?|remains?) (?:withheld|withdrawn|blocked|open)",
        "wish": "(?:i|we)(?:'d| would)? (?:prefer|rather|like|ask|suggest)(?: that)?(?: you)?",
        "alone": r"you (?:do|solve|try|work|to do|to solve|to try|complete|figure)\b[^.!?]*\b(?:yourself|on your own|alone|by yourself)",
        "topic": "(?:talk|speak|chat) about something (?:else|different)|change the (?:subject|topic)|another topic instead",
        "today": r"not doing (?:\w+ ){1,3}(?:today|now|here|anymore)",
        "against": "against (?:my|the|our) (?:policy|policies|rules|guidelines|instructions|principles)",
    },
    "de": {
        "regret": "leider|bedauere|bedaure|entschuldigung|verzeihung|tut mir leid|als (?:assistent|modell|ki)",
        "negated": r"nicht (?:helfen|beantworten|lösen|weiterhelfen|antworten|möglich|dienen|bearbeiten|rechnen)|kein\w* (?:antwort|hilfe|lösung)|ablehnen|weigern|verweigern|passen",
        "modal": "kann ich|kann dir|kann ihnen|ich kann|darf ich|ich darf|muss ich|ich muss|werde ich|ich werde|möchte ich|ich möchte",
    },
    "fr": {
        "regret": "désolée?|je regrette|malheureusement|pardon|en tant qu['e]\\s?\\w+",
        "negated": r"(?:ne|n['e]) ?\w+ pas \w+|refuser|refuse|décliner|impossible de",
        "modal": "je ne peux|je ne suis|je ne veux|je ne saurais|je dois|je refuse|il m'est|je n",
    },
    "es": {
        "regret": "lo siento|perdón|disculpa|disculpe|lamentablemente|por desgracia|como (?:asistente|modelo)",
        "negated": r"no (?:puedo|voy a|me es posible|estoy en condiciones|quiero|debo|podré)|negarme|rechazar|declinar",
        "modal": "no puedo|no voy a|no me es posible|no estoy|debo (?:negarme|rechazar|declinar)|tengo que (?:negarme|rechazar)",
    },
    "it": {"regret": "mi dispiace|purtroppo|mi spiace|come assistente", "negated": r"non (?:posso|sono in grado|voglio|mi è possibile)|rifiutare|declinare", "modal": "non posso|non sono in grado|devo (?:rifiutare|declinare)"},
    "nl": {"regret": "helaas|sorry|het spijt me", "negated": r"niet (?:helpen|beantwoorden|oplossen)|geen (?:antwoord|hulp)|weigeren", "modal": "kan ik niet|ik kan niet|ik moet weigeren"},
    "pt": {"regret": "desculpe|infelizmente|lamento", "negated": r"não (?:posso|consigo|vou)|recusar", "modal": "não posso|não consigo|devo recusar"},
}
SENTENCES = {
    "en": (
        "agent [how] negation [how] [being] act", "start negation [how] [being] act", "agent [how] duty [how] decline", "agent [how] decline", "impossible act", "beyond", "agent lack", "kind unsupported", "rules forbid", "outcome withheld", "wish alone", "topic", "today", "against",
    ),
}
FOREIGN = ("regret ... negated", "modal ... negated")


def _compiled(rule: str, slots: dict[str, str]) -> str:
    """A sequence of slots as a pattern: blanks between, anything up to the sentence's end for dots."""
    out = ""
    for part in rule.split():
        if part == "...":
            out += r"[^.!?]*?"
        elif part.startswith("["):
            out += rf"(?:\b(?:{slots[part[1:-1]]})\s+)?"
        elif part == "start":
            out += f"(?:{slots[part]})"
        else:
            out += rf"(?:(?<!\w)(?:{slots[part]})(?!\w)\s*)"
    return out


REFUSAL = re.compile("|".join(_compiled(rule, slots) for lang, slots in SLOTS.items() for rule in SENTENCES.get(lang, FOREIGN)))
TOKEN = re.compile(r"-?\d+(?:\.\d+)?|[^\W\d_]+")
DIGITS = re.compile(r"\d+")
ENDS = re.compile(r"(?<=[.!?])\s+|\n+")
TILE = 3
#: Running hashes of tiles.
BASE, PRIME = 1_000_003, (1 << 61) - 1


def response_of(content: str | None) -> str | None:
    """What the answer tag holds (to the end if it isn't closed), else the content without its thoughts, if any is left."""
    if content is None:
        return None
    at = content.rfind("<answer>")
    if at >= 0:
        return content[at + 8 :].split("</answer>")[0]
    rest = re.sub(r"(?s)<think>.*?</think>", "", content)
    return rest if rest.strip() else content


def is_empty(text: str | None) -> bool:
    if text is None:
        return True
    bare = re.sub(r"[\W_]+", "", S.plain(text)).lower()
    return not bare or bare in NO_ANSWER


def tiling(a: list[str], b: list[str], least: int = TILE, again: bool = False) -> tuple[set[int], set[int]]:
    """Greedy string tiling: places of ``a`` and ``b`` under the longest common tiles, marked longest first.

    Running hashes: for tile lengths that fall by halves, every unmarked window of ``b`` is hashed
    once, and each window of ``a`` that meets one is stretched as far as it goes, longest tiles
    first. Without ``again`` a place of ``b`` serves once; with it, b may be given back many times.
    """
    free_a, free_b = [True] * len(a), [True] * len(b)
    length = max(min(len(a), len(b)), least) if min(len(a), len(b)) >= least else 0
    while length >= least:
        where: dict[int, list[int]] = {}
        for j, key in _windows(b, free_b, length):
            held = where.setdefault(key, [])
            if len(held) < 2 or not again:
                held.append(j)
        tiles = []
        for i, key in _windows(a, free_a, length):
            for j in where.get(key, ())[:8] if again else where.get(key, ()):
                if a[i : i + length] == b[j : j + length]:
                    n = length
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                        n += 1
                    tiles.append((-n, i, j))
                    break
        marked = False
        for n, i, j in sorted(tiles):
            n = -n
            while n >= length and not (all(free_a[i : i + n]) and all(free_b[j : j + n])):
                n -= 1  # another tile took its end
            if n >= length:
                free_a[i : i + n] = [False] * n
                if not again:
                    free_b[j : j + n] = [False] * n
                marked = True
        if not (marked and tiles):
            length = length // 2 if length // 2 >= least or length == least else least
    return {i for i, f in enumerate(free_a) if not f}, {j for j, f in enumerate(free_b) if not f}


def _windows(tokens: list[str], free: list[bool], length: int):
    """Start and running hash of each window of unmarked tokens."""
    value, top, run = 0, pow(BASE, length - 1, PRIME), 0
    for k, t in enumerate(tokens):
        if not free[k]:
            value, run = 0, 0
            continue
        if run == length:
            value = (value - hash(tokens[k - length]) * top) % PRIME
            run -= 1
        value = (value * BASE + hash(t)) % PRIME
        run += 1
        if run == length:
            yield k - length + 1, value


def is_copy(prompt: str | None, text: str) -> bool:
    """Whether a plain() response gives the prompt back, once or more, and nothing more."""
    if not prompt:
        return False
    a, b = TOKEN.findall(text.lower()), TOKEN.findall(S.plain(prompt).lower())
    words = [i for i, t in enumerate(a) if t[0].isalpha()]
    asked = [j for j, t in enumerate(b) if t[0].isalpha()]
    set_a, set_b = set(a), set(b)
    if not words or sum(a[i] in set_b for i in words) < 0.7 * len(words) or not asked or sum(b[j] in set_a for j in asked) < 0.7 * len(asked):
        return False  # can't be covered
    if a == b:
        return True
    in_a, in_b = tiling(a, b, min(TILE, len(b)))
    if len(a) > len(b):  # the prompt may be given back more than once
        in_a |= tiling(a, b, min(TILE, len(b)), again=True)[0]
    new_numbers = {t for i, t in enumerate(a) if i not in in_a and not t[0].isalpha()} - set(b)
    return not new_numbers and sum(i in in_a for i in words) >= 0.7 * len(words) and sum(j in in_b for j in asked) >= 0.7 * len(asked)


@lru_cache(maxsize=50_000)
def declines(sentence: str) -> bool:
    """Whether the grammar reads a sentence, numbers masked, as a refusal. Sentences repeat."""
    return bool(REFUSAL.search(sentence))


def is_refusal(text: str, prompt: str | None) -> bool:
    """Whether a plain() response declines to answer: by the grammar, and stating no value of its own."""
    low = text.lower().replace("’", "'")
    if not any(declines(DIGITS.sub("0", sentence)) for sentence in ENDS.split(low)):
        return False
    own = set(re.findall(r"\d+", low)) - set(re.findall(r"\d+", prompt or ""))
    return not own and not re.search(r"(?:\b(?:is|equals|to|ist|est|es)|=|:)\s*-?[\[\d]", low)


def differs_in_language(prompt: str | None, text: str) -> bool:
    """Whether a plain() response is written in another language than the prompt."""
    return differs(S.MATRIX.sub(" ", S.plain(prompt or "")), S.MATRIX.sub(" ", text))


def classify(prompt: str | None, response: str | None, cut: bool) -> str | None:
    """The defect of a pair, or None."""
    if cut:
        return "truncated"
    if response and S.SCALAR.fullmatch(response):
        return None
    if is_empty(response):
        return "empty"
    text = S.plain(response)
    if not S.is_bare(text):
        if is_copy(prompt, text):
            return "copy"
        if is_refusal(text, prompt):
            return "refusal"
    if not S.is_bare(text) and differs_in_language(prompt, text):
        return "other_language"
    return None


def defects(pairs: DataFrame) -> DataFrame:
    """pair_kind, pair_id, defect of the defective rows of pair_kind, pair_id, prompt, response, cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = pa.array([classify(p, r, bool(c)) for _, _, p, r, c in S.rows(b)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), kind], names=["pair_kind", "pair_id", "defect"]).filter(kind.is_valid())

    return pairs.select("pair_kind", "pair_id", "prompt", "response", "cut").mapInArrow(run, "pair_kind string, pair_id bigint, defect string")


def question_texts(questions: DataFrame) -> DataFrame:
    """Answers as texts to judge, questions as further copies. Keys begin with q."""
    rows = questions.select(F.concat(F.lit("q"), F.col("question_id").cast("bigint").cast("string")).alias("key"), "question", "answer", F.col("golden.final_answer").alias("final"))
    texts = rows.select(
        "key", F.lit(0).alias("pos"), F.col("answer").alias("text"), F.lit(True).alias("formal"), F.when(~has_letters(F.col("answer")), F.col("final")).alias("truths"), F.lit(True).alias("asked"),
        F.when(may_be_open(F.col("answer")) & has_letters(F.col("answer")), F.array("question")).alias("prompts"),
    ).filter("text is not null")
    return texts.unionByName(copies(rows, "question"))


def question_pairs(questions: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """question with answer. ``cut``: key, pos of cut texts; without it the answers alone are judged."""
    cut = cut_texts(question_texts(questions)) if cut is None else cut
    marked = cut.filter("key like 'q%'").select(F.expr("cast(substring(key, 2) as bigint)").alias("question_id"), F.lit(True).alias("cut"))
    rows = questions.select(F.col("question_id").cast("bigint").alias("question_id"), "question", "answer")
    return rows.join(marked, "question_id", "left").select(F.lit("question").alias("pair_kind"), F.col("question_id").alias("pair_id"), F.col("question").alias("prompt"), F.col("answer").alias("response"), "cut")


def task_pairs(conversations: DataFrame, tasks: DataFrame, cut: DataFrame | None = None) -> DataFrame:
    """instruction with the closing assistant message of each conversation of a task. ``cut`` as in question_pairs()."""
    cut = cut_texts(message_texts(conversations, tasks), task_prompts(conversations, tasks)) if cut is None else cut
    closing = F.expr("filter(transform(messages, (m, i) -> struct(i as pos, m.role as role, m.content as content, coalesce(size(m.tool_calls), 0) as calls)), m -> m.role = 'assistant' and m.calls <= 0)")
    last = conversations.select(F.col("idx").cast("bigint").alias("idx"), "task_id", F.try_element_at(closing, F.lit(-1)).alias("m")).filter("m is not null and task_id is not null")
    pairs = last.select("idx", "task_id", F.col("m.pos").alias("pos"), F.col("m.content").alias("content")).join(instructions(tasks), "task_id")
    marked = cut.filter("key not like 'q%'").select(F.col("key").cast("bigint").alias("idx"), "pos", F.lit(True).alias("cut"))
    respond = F.when(F.instr("content", "<") > 0, _response("content")).otherwise(F.col("content"))
    return pairs.join(marked, ["idx", "pos"], "left").select(F.lit("task").alias("pair_kind"), F.col("idx").alias("pair_id"), F.col("instruction").alias("prompt"), respond.alias("response"), "cut")


def _response(column: str):
    """response_of() as an expression."""
    inside = F.expr(f"split(element_at(split({column}, '<answer>', -1), -1), '</answer>', -1)[0]")
    rest = F.regexp_replace(column, "(?s)<think>.*?</think>", "")
    return F.when(F.instr(column, "<answer>") > 0, inside).when(F.trim(rest) != "", rest).otherwise(F.col(column))


def found(questions: DataFrame, conversations: DataFrame, tasks: DataFrame) -> DataFrame:
    """pair_kind, pair_id, defect of every defective pair."""
    texts = question_texts(questions).unionByName(message_texts(conversations, tasks))
    cut = cut_lineage(cut_texts(texts, task_prompts(conversations, tasks)))  # one look-up over the sentences of all texts
    return defects(question_pairs(questions, cut).unionByName(task_pairs(conversations, tasks, cut)))


def report(questions: DataFrame, conversations: DataFrame, tasks: DataFrame) -> DataFrame:
    """Number of pairs per kind and defect."""
    return found(questions, conversations, tasks).groupBy("pair_kind", "defect").agg(F.count("*").alias("n_pairs"))
