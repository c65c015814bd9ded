"""Defective answers: replies to prompts and stage rows of chunks (problem 2)."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.llm.completeness import BARE, COPY_STAGES, CUT, ENDED, EXPECTED, MARKER, NO_CHANGES, TAGS, bare, baseline, completeness, decided, is_copy, kind_of, prompt_passage
from palimp.llm.language import Languages, fitted, fold
from palimp.plans.durable import durable, spread

#: Triggered defects in the order that decides which one a record is listed with.
ORDER = ["empty", "refusal", "copy", "other_language", "truncated"]
REVISION_STAGES = ["translate", "reflect", "proofread", "style", "verify", "repair"]
#: A refusal declines in one of its first sentences, outside speech, and goes on with no further paragraph.
FIRST_SENTENCES = 2
SENTENCE = regex.compile(r"[.!?…。！？]+[\s»”\"*_]*(?=\s|$)|[。！？]|—\s(?=[A-ZА-Я])")
SPEECH_WITHIN = regex.compile(r"[.!?…]\s*[—–«“„\"]|[«“„]")
LABEL = regex.compile(r"^[\s*_#>`-]*(?:(?:note|notice|answer|response|assistant|примечание|ответ|примітка|відповідь|hinweis|antwort|nota|respuesta|remarque|réponse)\s*[:：][\s*_]*)?", regex.I)
#: A tag or marker that breaks off at the end: no words of a paragraph.
CUT_MARK = regex.compile(r"(?:</?[A-Za-z][^<>]*|^===[A-Z]*[ \d]*=*)\s*\Z", flags=regex.M)
SPEECH = regex.compile(r"^\s*[—–«“„\"'‘]")
#: How models decline, by language.
REFUSAL = regex.compile(
    "|".join(
        [
            r"\b(?:can(?:'|’)?t|cannot|can not|could not|couldn(?:'|’)t|won(?:'|’)t|will not|am not able to|(?:'|’)m not able to|not be able to|unable to|must decline to|have to decline|not comfortable|refuse to|not allowed to|not permitted to)\b.{0,40}\b(?:help|assist|translate|continue|reproduce|provide|comply|fulfil+|complete|process|proceed|do|request|passage|text|chapter|content|excerpt)\b",
            r"\b(?:goes|is|are) against (?:the|my|our)\b.{0,20}\b(?:guidelines|polic(?:y|ies)|rules)",
            r"\bviolates? (?:the|my|our)\b",
            r"\bnot something I can (?:do|help|assist)",
            r"\bas an? (?:AI|language|large language)\b.{0,20}\b(?:model|assistant)\b",
            r"(?:не могу|не смогу|не вправе|не имею права|не в состоянии|невозможно|нельзя|отказываюсь|вынужден отказать|не готов).{0,60}(?:перев|запрос|отрыв|текст|помо|продолж|выполн|фрагмент|материал|глав|содерж|насил)",
            r"(?:запрос|перев|отрывок|фрагмент)\w*.{0,30}(?:невозможн|не могу|нельзя)",
            r"нарушает (?:\w+ )?правил",
            r"как (?:языковая модель|искусственный интеллект|ии\b)",
            r"(?:не можу|не зможу|не вправі|не маю права|неможливо|не в змозі|відмовляюся).{0,60}(?:перекл|запит|урив|текст|допомо|продовж|викон|фрагмент|матеріал|розділ|зміст|насил)",
            r"(?:запит|переклад|уривок|фрагмент)\w*.{0,30}(?:неможлив|не можу)",
            r"порушує (?:\w+ )?правил",
            r"як (?:мовна модель|штучний інтелект)",
            r"\b(?:kann|darf|könnte|werde|möchte)\b.{0,60}\bnicht\b.{0,20}\b(?:übersetz|bearbeit|helf|fortsetz|fortfahr|erfüll|wiedergeb|beantwort|weiter)",
            r"\bverstößt gegen\b|\bist mir nicht möglich\b|\bnicht in der lage\b|\bals (?:sprachmodell|ki)\b",
            r"\b(?:no puedo|no podré|no podría|no me es posible|no es posible|no estoy autorizad[oa]|no tengo permitido|imposible)\b.{0,40}\b(?:tradu|aten|ayud|continu|reprod|proces|complet|solicitud|fragmento|texto|pasaje|cap[ií]tulo|contenido)",
            r"\b(?:va en contra|infringe|incumple)\b.{0,20}\b(?:normas|pol[ií]ticas?|directrices|reglas)",
            r"\bcomo (?:modelo de lenguaje|asistente|ia\b|inteligencia)",
            r"\bje ne (?:peux|puis|suis|pourrai)\b.{0,40}\b(?:tradui|aider|continu|reprod|trait|mesure|demande|passage|texte|extrait)|ne m['’]est pas possible|\ben tant que (?:modèle|assistant|ia)|\benfreint|va à l['’]encontre",
            r"(?:できません|できかねます|致しかねます|お断り|お手伝いでき|翻訳でき)",
            r"(?:无法|不能|不可以|拒绝|無法|抱歉).{0,30}(?:翻译|翻譯|帮助|协助|处理|继续|完成|提供|满足|該|此|内容|请求)",
            r"(?:할 수 없|드릴 수 없|도와드릴 수|번역할 수 없|불가능합니다|거절)",
            r"\b(?:çeviremem|çeviremiyorum|yardımcı olamam|yardımcı olamıyorum|devam edemem|yerine getiremem|mümkün değil)",
            r"\bnem (?:tudom|tudok|fordíthatom|segíthetek|áll módomban|lehetséges)\b.{0,50}(?:fordít|segít|folytat|szöveg|kérés|teljesít|részlet)|\bnem segíthetek\b",
            r"\bnemohu\b.{0,50}(?:přelož|překlád|pomoc|pomoci|pokrač|text|žádost|úryv)|\bnemôžem\b.{0,50}(?:prelož|pomôcť|pokrač|text|žiados)",
            r"\bkan (?:ik )?(?:deze|dit|u|je|hier)?.{0,30}niet\b.{0,30}(?:vertal|help|voortzet|doorgaan|verzoek|tekst)",
            r"\bkan (?:inte|ikke|tyvärr inte|dessverre ikke|desværre ikke)\b.{0,50}(?:översätt|hjälp|fortsätt|oversett|hjelpe|fortsett|oversætt|hjælpe|fortsætt|text|tekst)",
            r"\ben (?:voi|pysty|kykene)\b.{0,40}(?:kääntä|auttaa|jatkaa|teksti|pyyntö)",
            r"\bnu pot\b.{0,40}(?:traduc|ajut|continu|text|cerer|pasaj)|\bne mogu\b.{0,40}(?:prev|pomo|nastav|tekst|zahtj|zahtev)|не мога.{0,40}(?:прев|помог|продълж|текст|заявк)",
            r"\bδεν μπορώ\b.{0,40}(?:μεταφρ|βοηθ|συνεχ|κείμεν|αίτημ)|(?:لا أستطيع|لا يمكنني|أعتذر).{0,40}(?:ترجم|مساعد|النص|الطلب|متابع)|(?:איני יכול|לא יכול).{0,40}(?:לתרגם|לעזור|הטקסט)",
            r"\bnon posso\b.{0,40}\b(?:tradu|aiut|continu|richiesta|testo|brano)|\bnão posso\b.{0,40}\b(?:tradu|ajud|continu|pedido|texto|trecho)|\bnie mogę\b.{0,40}\b(?:tłumacz|przetłumacz|pomóc|kontynu|tekst|fragment)",
        ]
    ),
    regex.I | regex.S,
)


def paragraphs(text: str) -> list[str]:
    parts = MARKER.split(text)
    if len(parts) > 1:
        parts = [parts[0], *parts[2::2]]
    else:
        parts = text.split("\n")
    return [q for p in parts if (q := TAGS.sub(" ", p).strip())]


def is_empty(text: str, full: bool) -> bool:
    """No letter or digit outside marker lines, tags and fences; ``full``: an answer that states no
    changes is one."""
    body = bare(text)
    if full and NO_CHANGES.match(regex.sub(r"```[\w-]*", "", text).strip()):
        return False
    return not any(map(str.isalnum, body))


def is_refusal(text: str) -> bool:
    """Declines in one of the first sentences, outside speech, and gives no more than one paragraph of what was
    asked for. Its length doesn't matter."""
    if sum(1 for _ in MARKER.finditer(text)) > 1:
        return False
    body = regex.sub(r"\s+", " ", bare(text)).strip()
    if not body or body[0] in "[{":
        return False
    body = LABEL.sub("", body, 1)
    if SPEECH.match(body):
        return False
    ends = [m.end() for _, m in zip(range(FIRST_SENTENCES), SENTENCE.finditer(body))]
    found = REFUSAL.search(body, 0, ends[-1] if len(ends) == FIRST_SENTENCES else len(body))
    return found is not None and not SPEECH_WITHIN.search(body[: found.start()])


def foreign(verdicts: list[bool | None]) -> bool:
    """All paragraphs, or all but one, are in another language; those that speak for none don't count."""
    other, own = sum(v is True for v in verdicts), sum(v is False for v in verdicts)
    return own <= 1 and other >= 1 and other >= own


def strange(texts: list[str], targets: list[str], languages: Languages) -> list[bool]:
    """Whether each text is, but for one paragraph at most, in another language than its target. The
    paragraphs of all texts are read at once."""
    held = [paragraphs(CUT_MARK.sub("", t)) for t in texts]
    verdicts = iter(languages.differ([p for ps in held for p in ps], [t for ps, t in zip(held, targets) for _ in ps]))
    return [foreign([next(verdicts) for _ in ps]) for ps in held]


def defects(text: str | None, is_strange: bool | None, translated: bool, may_be_unchanged: bool, passage: Callable[[], list[str]] | None, prompt: str | None = None) -> tuple[list[str], str, str | None, bool]:
    """(triggered defects but for ``truncated``, state and kind of the ending, whether the passage is needed) of a
    folded text. Every rule is tried, but for those another rules out: an empty text has no language, and
    a refusal or copy is no text in another language.

    ``translated``: the answer should be a translation, so copies and other languages count; ``is_strange`` is
    what ``strange`` says of it. Without ``passage`` what depends on it is left open and the flag is set."""
    if text is None or not text or is_empty(text, may_be_unchanged):
        return ["empty"], "whole", None, False
    out = ["refusal"] if is_refusal(text) else []
    state, number, plain = completeness(text)
    ask = passage is None and state == BARE
    if translated and not out and is_strange:
        if passage is None:
            ask = True
        elif is_copy(text, passage() + ([prompt] if prompt else [])):
            out.append("copy")
        else:
            out.append("other_language")
    elif translated and not out and prompt and is_copy(text, [prompt]):
        out.append("copy")
    kind = kind_of(number, plain, passage()) if passage is not None and state in (BARE, ENDED) else None
    return out, state, kind, ask


def _looked_at(rows: list[tuple], languages: Languages) -> list[tuple]:
    """(text folded, whether it is strange or None) for ``(text, target, translated)``, all languages at once."""
    folded = [fold(t) if t else t for t, _, _ in rows]
    wanted = [i for i, (t, target, translated) in enumerate(rows) if translated and target and t]
    found = dict(zip(wanted, strange([folded[i] for i in wanted], [rows[i][1] for i in wanted], languages)))
    return [(t, found.get(i)) for i, t in enumerate(folded)]


@lru_cache(maxsize=2)
def _languages(counts: tuple) -> Languages:
    return Languages({lang: dict(held) for lang, held in counts})


def _models(documents: DataFrame):
    counts = fitted(documents)
    return documents.sparkSession.sparkContext.broadcast(tuple((lang, tuple(sorted(held.items()))) for lang, held in sorted(counts.items())))


def _endings_of_completions(df: DataFrame, models) -> DataFrame:
    """``(record_id, provider, fld, defects, state, kind)`` of every completion, each once, written."""
    named = df.select("completion_id", "provider", "stage", "target_lang", "user_prompt", "text")

    def run(batches):
        languages = _languages(models.value)
        for batch in batches:
            ids, providers, stages, targets, prompts, texts = (c.to_pylist() for c in batch.columns)
            looked = _looked_at([(t, g, s in COPY_STAGES) for t, g, s in zip(texts, targets, stages)], languages)
            out = [defects(t, odd, s in COPY_STAGES and g is not None, s == "proofread", lambda p=p: prompt_passage(p), p) for (t, odd), s, g, p in zip(looked, stages, targets, prompts)]
            columns = [pa.array(ids, pa.int64()), pa.array(providers, pa.string()), pa.array(["text"] * len(ids), pa.string()), pa.array([o[0] for o in out], pa.list_(pa.string())), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["record_id", "provider", "fld", "defects", "state", "kind"])

    return durable(spread(named).mapInArrow(run, "record_id bigint, provider string, fld string, defects array<string>, state string, kind string").distinct())


def _with_truncated(found: DataFrame, is_cut: Column) -> DataFrame:
    whole = F.concat("defects", F.when(is_cut, F.array(F.lit("truncated"))).otherwise(F.expr("cast(array() as array<string>)")))
    return found.select("record_id", whole.alias("defects")).filter(F.size("defects") > 0)


def find_in_completions(df: DataFrame, documents: DataFrame) -> DataFrame:
    """``(record_set, record_id, defects)`` for every completion with a defect; languages are told by the labelled
    texts of ``documents(lang, text)``.

    A null text is ``empty``; a null target language or prompt only rules out what needs it; repeated
    rows count once; other columns are ignored."""
    return _of_completions(_endings_of_completions(df, _models(documents)))


def _of_completions(endings: DataFrame) -> DataFrame:
    return _with_truncated(decided(endings), F.col("is_cut")).distinct().select(F.lit("completions").alias("record_set"), "record_id", "defects")


def find_in_revisions(revisions: DataFrame, chunks: DataFrame, passages: DataFrame, documents: DataFrame, may_end_bare: dict[str, bool] = EXPECTED) -> DataFrame:
    """``(record_set, record_id, defects)`` for every stage row of ``REVISION_STAGES`` with a defect.

    Rows with a null chunk_id stay out; a null content is ``empty``. Most rows are decided alone; only
    those that end bare or look foreign are joined with their chunk's paragraphs. A chunk without
    paragraphs leaves such rows to the rules that need none. Repeats count once. Which kinds of endings may
    be bare is given by ``may_end_bare``."""
    return _of_revisions(revisions, chunks, passages, _models(documents), may_end_bare)


def _of_revisions(revisions: DataFrame, chunks: DataFrame, passages: DataFrame, models, may_end_bare: dict[str, bool]) -> DataFrame:
    named = revisions.filter(F.col("chunk_id").isNotNull() & F.col("stage").isin(REVISION_STAGES)).select("seq", "target_lang", "book_id", "chunk_id", "content")

    def alone(batches):
        languages = _languages(models.value)
        for batch in batches:
            seqs, targets, books, held, texts = (c.to_pylist() for c in batch.columns)
            out: list[list] = [[] for _ in range(6)]
            for seq, target, book, chunk, text, (folded, odd) in zip(seqs, targets, books, held, texts, _looked_at([(t, g, True) for t, g in zip(texts, targets)], languages)):
                own, state, _, ask = defects(folded, odd, target is not None, False, None)
                if state == CUT:
                    own = [*own, "truncated"]
                if own or ask:
                    for column, x in zip(out, (seq, odd, book, chunk, text if ask else None, None if ask else own)):
                        column.append(x)
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["seq", "odd", "book_id", "chunk_id", "content", "defects"])

    first = durable(spread(named).mapInArrow(alone, "seq bigint, odd boolean, book_id bigint, chunk_id string, content string, defects array<string>"))
    asked = first.filter("defects is null").drop("defects").dropDuplicates(["seq"])
    wanted = asked.select("book_id", "chunk_id").distinct()
    places = chunks.select("book_id", "chunk_id", "chapter_idx", "para_idx").filter("chunk_id is not null").join(wanted, ["book_id", "chunk_id"], "left_semi").distinct()
    places = places.select("book_id", "chunk_id", "chapter_idx", F.posexplode("para_idx").alias("_pos", "para_idx"))
    texts = passages.select("book_id", "chapter_idx", "para_idx", F.col("text").alias("_text"))
    source = places.join(texts, ["book_id", "chapter_idx", "para_idx"]).groupBy("book_id", "chunk_id").agg(F.array_sort(F.collect_set(F.struct("_pos", F.coalesce("_text", F.lit("")).alias("_text")))).alias("_source"))
    joined = asked.join(source, ["book_id", "chunk_id"], "left").select("seq", "odd", "content", F.expr("transform(_source, x -> x._text)").alias("_source"))

    def compared(batches):
        for batch in batches:
            ids, found = [], []
            for seq, odd, text, given in zip(*(c.to_pylist() for c in batch.columns)):
                own, state, kind, _ = defects(fold(text), odd, odd is not None, False, lambda g=given: list(g or []))
                if state == CUT or (state == BARE and not may_end_bare.get(kind, EXPECTED[kind])):
                    own = [*own, "truncated"]
                if own:
                    ids.append(seq)
                    found.append(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.string()))], names=["record_id", "defects"])

    second = joined.mapInArrow(compared, "record_id bigint, defects array<string>")
    decided_alone = first.filter("defects is not null").select(F.col("seq").alias("record_id"), "defects").distinct()
    return decided_alone.unionByName(second).select(F.lit("revisions").alias("record_set"), "record_id", "defects")


def find_defects(completions: DataFrame, revisions: DataFrame, chunks: DataFrame, passages: DataFrame, documents: DataFrame) -> DataFrame:
    """``(record_set, record_id, defects)`` of both. The kinds of endings of revisions may be bare where those of
    the completions' texts, of all sources together, may: their sources are not named."""
    models = _models(documents)
    endings = _endings_of_completions(completions, models)
    pooled = baseline(endings.withColumn("provider", F.lit("every"))).collect()  # one row per kind
    known = {r["kind"]: r["may_end_bare"] for r in pooled}
    return _of_completions(endings).unionByName(_of_revisions(revisions, chunks, passages, models, known))


def first_defect(found: Column) -> Column:
    rank = F.lit(None).cast("string")
    for name in reversed(ORDER):
        rank = F.when(F.array_contains(found, name), name).otherwise(rank)
    return rank


def p2_defects(spark, root: str) -> DataFrame:
    return find_defects(*(spark.read.parquet(f"{root}/{n}.parquet") for n in ("completions", "revisions", "chunks", "paragraphs", "documents")))


def p2_found(spark, root: str) -> DataFrame:
    return p2_defects(spark, root).select("record_set", "record_id", first_defect(F.col("defects")).alias("defect")).distinct()
