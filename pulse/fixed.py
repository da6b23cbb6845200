"""Constants that results depend on character for character.

These are data, not logic: stop words, patterns, templates and paths.
"""

from __future__ import annotations

# --- Fixed values: whitespace removed by a Unicode-aware trim ---------------
WHITESPACE = "".join(
    map(
        chr,
        [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B)]
        + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000],
    )
)

# --- Fixed values: names that are never counted as people -------------------
SOCIAL_NETWORKS = [
    "facebook",
    "twitter",
    "instagram",
    "linkedin",
    "whatsapp",
    "youtube",
]
MIN_PERSON_CHARS = 3

# --- Fixed values: patterns -------------------------------------------------
URL_PATTERN = r"https?://\S+"
SCORE_PATTERN = r"-?\d+\.\d+"
LENIENT_SCORE_PATTERN = r"-?\d+(\.\d+)?"
# applied in this order to the lower-cased theme list
THEME_REWRITES = [
    (r"(?i)uspec_", ""),
    (r"(?i)wb_\d+_", ""),
    (r"(?i)tax_fncact_", "tax "),
    (r"(?i)crisislex_[^, ]+", "crisis response"),
    (r"_", " "),
]
PEOPLE_NOISE = r"(?i)\bLos Angeles\b,?\s*"
# a new word starts after whitespace or any of these
WORD_DELIMITERS = r"""[\s\[\](){}/|\\<>!?@"^#$&~_,.:;*%+\-]"""

# --- Fixed values: where a raw model response may hold its text -------------
RESPONSE_PATHS = [
    "$.ml_generate_text_result.candidates[0].content.parts[0].text",
    "$.ml_generate_text_result.candidates[0].content[0].text",
    "$.predictions[0].content",
    "$.text",
]

# --- Fixed values: text formats ---------------------------------------------
TOPIC_DOC = (
    "Country: {country} | Date: {event_date} | "
    "Headlines: {headline_count} | "
    "Tone avg/min/max: {avg_tone}/{min_tone}/{max_tone} | "
    "Top Event Codes: {codes} | "
    "Sample URLs: {urls}"
)
CODE_SEPARATOR = ", "
URL_SEPARATOR = " | "
ENTITY_SEPARATOR = ", "
ANALOG_LINE = "{past_date}: {snippet}"
ANALOG_SEPARATOR = "\n- "
NO_ANALOGS = "None"
NO_ENTITIES = "none"

BRIEFING_PROMPT = """\
You are a news analyst. Country is an ISO code.
Fill in this EXACT template with ≤90 words, no intro/outro:
[What happened] 
[Key drivers] 
[Impact] 
[Watch next] 
Rules:
- Only summarize events for ISO code {country}.
- Use at least TWO items from "Top themes (readable)" and at least ONE name from "Top people".
- Do NOT output raw taxonomy tokens. Use natural English phrases.
- Do NOT mention event codes. Avoid boilerplate.
- Include at least one concrete number if available.
- ALWAYS include all 4 sections.
- Limit each section to 1–2 sentences. Be concise and specific.
Top themes (readable): {themes}
Top people: {people}
Context: {context}
Relevant past events to consider (analog history):
{analogs}"""

SENTIMENT_PROMPT = """\
You are a sentiment analysis model. Read the news briefing and respond with a single number \
between -1 (very negative) and 1 (very positive).
Briefing:
{briefing}
Sentiment score:"""

SUMMARY_PROMPT = (
    'Summarize today’s news mood for the ISO country code "{country}". '
    "Write ONE sentence (≤25 words). "
    "Do not use labels. "
    "Keep it concise, neutral, and hover-friendly."
)
