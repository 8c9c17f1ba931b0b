"""Literal texts that exercise what the synthetic documents lack: contractions, questions,
lists, headings, dashes, emoji, greetings and machine-writing habits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_ID = 1_000_000_000

_LONG = (
    "While the plan looks simple, the work is not. However, we can't ignore the cost. Trust is a habit. "
    "It's not the tool, but the team, that matters. The system is fast, cheap, and reliable, making it a robust choice. "
    "Moreover, it may potentially fail. You should test it, and you shouldn't wait. We tried. We failed. We learned. "
)

TEXTS = (
    "Hi Anna,\n\nCould you possibly check this? I'm not sure it's right... Thanks!\n\nKind regards,\nSam",
    "Dear team,\n\nPlease note e.g. the 3.5 percent rise (see the table). Dr. Who said so. Is it possible?\n\nBest",
    "# Plan\n\n- First item. With two parts.\n- Second item\n\nWe go on – slowly - to the end — really. Great :) \U0001f600",
    "Title\n=====\n\nI think we should realise the colour. You probably organise it. In fact, however, we delve into it.",
    _LONG * 3,
    "## Notes\n\n" + _LONG * 2 + "\n\n**Summary**\n\n1. **Cost:** low\n2. **Risk:** high\n3. **Time:** short\n\n" + _LONG,
    "Feel free to contact me. I hope this helps. Don't hesitate to call. Let me know if you need anything else.",
    "Morning all,\nNo worries. It works. It runs. It ends. It rests.\nThis line goes on\nand on\nSent from my iPhone",
    "The meeting, including lunch, is set. They left, smiling. She came, bringing cake. He sat, reading. We ate, talking. All fine.",
    "Jane Doe,\n\nYour account balance is due. Ring 1234567 or write to a.b@example.com now; see www.example.com/x, please.",
    "",
    "Regards",
    "One thing is clear.\n\nIt works.\n\nNobody minds.\n\nThat is all there is. Or nearly.",
)


def sql_values() -> str:
    quoted = ", ".join(f"({BASE_ID + k}, '{t.replace(chr(39), chr(39) * 2)}', 'en', 'src{k % 3}', {len(t)})" for k, t in enumerate(TEXTS))
    return f"(VALUES {quoted}) AS v(doc_id, text, lang, source, n_chars)"


def frame(spark: SparkSession) -> DataFrame:
    rows = [(BASE_ID + k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
