"""Order-preserving chunks of long texts and map-reduce over them with a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

#: Fixed value: the size of a summary's chunk in UTF-8 bytes.
CHUNK_BYTES = 20_000


def split_lines(text: str, most: int) -> list[str]:
    """Lines packed greedily into chunks of at most `most` bytes; a longer line is cut every `most` bytes, broken characters
    become U+FFFD. Blank lines at a chunk's beginning vanish. There is always one chunk."""
    out, now = [], b""
    for line in text.encode().split(b"\n"):
        line = line.removesuffix(b"\r")
        if now and len(now) + len(line) + 1 > most:
            out.append(now)
            now = b""
        if len(line) > most:
            if now:
                out.append(now)
                now = b""
            cuts = [line[i : i + most] for i in range(0, len(line), most)]
            out += cuts
            continue
        now = now + b"\n" + line if now else line
    if now or not out:
        out.append(now)
    return [x.decode("utf-8", "replace") for x in out]


def chunks(docs: DataFrame, most: int = CHUNK_BYTES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk, text) for each document; a null text is an empty one. The packing is sequential within a document only."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, i, c) for k, t in zip(p[key], p[text], strict=True) for i, c in enumerate(split_lines(t or "", most))]
            yield pd.DataFrame(rows, columns=[key, "chunk", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.coalesce(text, F.lit("")).alias(text)).mapInPandas(run, f"{key} {kind}, chunk int, text string")


def stub_generator(prompt: str, most: int) -> str:
    """Stands for a language model where no weights are at hand: the prompt's beginning."""
    return prompt[:most]


def generated(rows: DataFrame, generate: Callable[[str, int], str], most: int) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(answer=[generate(x, most) for x in p["prompt"]])

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))


#: What the models are told, and the structures of the built-in templates.
SYSTEM = (
    "Du är en noggrann svensk mötessekreterare. Sammanfatta ENBART det som faktiskt sägs i underlaget. Hitta ALDRIG på beslut, namn, siffror eller åtgärder. "
    "Om något är oklart eller saknas, skriv inget om det. Skriv koncis, korrekt svenska."
)
QA_SYSTEM = (
    "Du svarar på frågor om ett möte. Svara ENBART utifrån transkriptet nedan. Hitta ALDRIG på fakta, namn eller siffror. "
    "Om svaret inte framgår av transkriptet, säg tydligt att det inte framgår. Svara koncist på svenska."
)
MAP_ASK = "Sammanfatta nyckelpunkterna i detta utdrag ur ett möte som korta neutrala punkter (beslut, åtgärder, ämnen). Underlag:\n\n"
FINAL_ASK = "\n\nUnderlag (mötestranskript eller delsammanfattningar):\n\n"
CUSTOM = (
    "Strukturera sammanfattningen enligt användarens egen mall nedan. Använd exakt dessa rubriker som ## -rubriker och fyll i relevant innehåll under varje "
    "(utelämna en rubrik om inget relevant sägs):\n"
)
STRUCTURES = {
    "protokoll": "Strukturera som ett mötesprotokoll med dessa rubriker (utelämna en rubrik om inget relevant sägs):\n## Deltagare\n## Dagordning\n## Diskussion\n## Beslut\n## Åtgärder (vem – vad – när)\n## Övrigt",
    "sammanfattning": "Skriv:\n## Sammanfattning\n(2–4 meningar)\n## Viktigaste punkter\n(punktlista)",
    "actions": "Lista:\n## Beslut\n(punktlista)\n## Åtgärder\n(punktlista, ange ansvarig och tidsram när det framgår)",
}
ACTIONS_ASK = (
    "Lista alla åtgärder, beslut och att-göra-punkter från mötet. Svara med EN punkt per rad och börja varje rad med \"- \". "
    "Skriv ingenting annat än listan. Finns inga åtgärder, svara med en tom rad."
)


def chat_prompt(system: str, *parts: Column | str) -> Column:
    """A system and a user message, and the beginning of the answer."""
    user = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat(F.lit(f"<|im_start|>system\n{system}<|im_end|>\n<|im_start|>user\n"), *user, F.lit("<|im_end|>\n<|im_start|>assistant\n"))


def map_prompt(text: Column) -> Column:
    return chat_prompt(SYSTEM, MAP_ASK, text)


def final_prompt(text: Column, structure: str) -> Column:
    return chat_prompt(SYSTEM, structure + FINAL_ASK, text)


def question_prompt(text: Column, question: str) -> Column:
    return chat_prompt(QA_SYSTEM, "Mötestranskript:\n\n", text, f"\n\n---\nFråga: {question}")


def combining_prompt(text: Column, question: str) -> Column:
    return chat_prompt(QA_SYSTEM, "Delsvar från olika delar av mötet:\n\n", text, f"\n\n---\nVäv ihop delsvaren till ETT sammanhängande svar på frågan: {question}")


def structure_of(template: str, headings: str = "") -> str:
    """The structure that a template asks for; `custom` needs headings, an unknown template is an error."""
    if template == "custom":
        if not headings.strip():
            raise ValueError("a custom template needs headings")
        return CUSTOM + headings
    if template not in STRUCTURES:
        raise ValueError(f"unknown template: {template}")
    return STRUCTURES[template]


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def folded_parts(docs: DataFrame, one: Callable[[Column], Column], each: Callable[[Column], Column], last: Callable[[Column], Column], tokens: tuple[int, int, int], generate: Callable[[str, int], str], most: int) -> DataFrame:
    """(doc_id, answer): a text of one chunk is asked once, by `one`; of more, each chunk by `each`, and then the trimmed answers in order
    by `last`. tokens: the most for these three."""
    parts = chunks(docs, most).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole"))
    single = parts.where("n = 1").select("doc_id").join(whole, "doc_id").select("doc_id", one(F.col("whole")).alias("prompt"))
    first = generated(single, generate, tokens[0]).select("doc_id", "answer")
    many = generated(parts.where("n > 1").select("doc_id", "chunk", each(F.col("text")).alias("prompt")), generate, tokens[1])
    piece = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "answer"))), lambda x: F.concat(F.lit("\n[Del "), (x.chunk + 1).cast("string"), F.lit("]\n"), trimmed(x.answer), F.lit("\n")))
    notes = many.groupBy("doc_id").agg(trimmed(F.array_join(piece, "")).alias("text"))
    return first.unionByName(generated(notes.select("doc_id", last(F.col("text")).alias("prompt")), generate, tokens[2]).select("doc_id", "answer"))


def summarized(docs: DataFrame, structure: str, generate: Callable[[str, int], str] = stub_generator, most: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, summary) of (doc_id, text) in a structure."""
    final = lambda t: final_prompt(t, structure)
    return folded_parts(docs, final, map_prompt, final, (1024, 512, 1024), generate, most).withColumnRenamed("answer", "summary")


def answered(docs: DataFrame, question: str, generate: Callable[[str, int], str] = stub_generator, most: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, answer) to a question about each text."""
    ask = lambda t: question_prompt(t, question)
    return folded_parts(docs, ask, ask, lambda t: combining_prompt(t, question), (512, 384, 512), generate, most)


def proposed_actions(docs: DataFrame, generate: Callable[[str, int], str] = stub_generator, most: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, ord, action): the action lines of the answer to ACTIONS_ASK, to be added to a job."""
    from .transcript import action_lines

    return action_lines(answered(docs, ACTIONS_ASK, generate, most), text="answer")
