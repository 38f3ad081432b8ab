"""Fixed values.

Everything in this file must be exactly this text or number for results to agree with
existing tutoring tables, prompts and citations. Nothing here is logic.
"""

# Chunking: window and overlap in characters, and the metadata defaults of a chunk.
CHUNK_CHARS = 1000
OVERLAP_CHARS = 200
CLASS_LEVEL = 8
LANGUAGE = "English"
DOCUMENT_SUFFIX = ".pdf"

# Retrieval: neighbours per question, default and as used when answering.
TOP_K = 3
ANSWER_TOP_K = 5

# Characters that count as outer whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Citation formats.
CONTEXT_BLOCK = (
    "[Source: Class {class_level} Science, Chapter {chapter_no}, Page {page_number}]\n"
    "TEXT: {text_content}"
)
SOURCE_LABEL = "Class {class_level} Science — Chapter {chapter_no}, Page {page_number}"
BLOCK_SEPARATOR = "\n\n"
NO_CONTEXT = "No relevant context found in textbooks."
NO_CONTEXT_REPLY = "Mujhe khed hai, par yeh jankari Class {class_level} {syllabus} mein nahi mili."

# Session titles and times.
TITLE_CHARS = 50
ELLIPSIS = "…"
DISPLAY_TITLE_CHARS = 38
UNTITLED = "Untitled Chat"
NEW_CHAT = "New Chat"
RAW_TIME_CHARS = 16
TOPIC_MESSAGES = 3
TOPIC_SEPARATOR = ", "

# Usage log.
METRIC_NAME = "Query Processed for {user_id}"
METRIC_VALUE = "1"

# Quizzes.
LETTERS = ["A", "B", "C", "D", "E", "F"]
OPTION_PREFIX = r"^[A-Z][.)]\s*"
UNANSWERED = "None"
CORRECT_TAG = "✓ CORRECT"
WRONG_TAG = "✗ WRONG"
BREAKDOWN_LINE = (
    "Q{question_no} [{tag}]\n"
    "  Question : {question}\n"
    "  Student  : {choice}\n"
    "  Correct  : {answer_key}"
)
HIGH_SCORE = 4
MEDIUM_SCORE = 2
BANDS = ["High", "Medium", "Low"]
REPORT_BAND = "Evaluated"
QUIZ_OUTPUT = "Quiz {quiz_no} Output:\n{analysis}"

# Model replies.
CODE_FENCE = r"(?s)```.*?```"
JSON_ARRAY = r"(?s)\[.*\]"
MIN_ANALYSIS_CHARS = 20
EMPTY_RESPONSE = "Error: Empty response"
EMPTY_QUIZ = "[]"
DEFAULT_ANALYSIS = (
    "Your quiz has been recorded. Detailed analysis unavailable — please try again."
)
NO_QUIZZES = "No quizzes taken in this session yet."
REPORT_FAILED = "Failed to generate comprehensive report. Please try again."

# Model requests.
MAX_TOKENS = 4095
ANSWER_TEMPERATURE = 0.2
QUIZ_TEMPERATURE = 0.1
EVALUATION_TEMPERATURE = 0.2
REPORT_TEMPERATURE = 0.3

# Prompts.
ANSWER_PROMPT = """You are a helpful Indian university teaching assistant. Use the provided Context Blocks to answer the student's question comprehensively.

CRITICAL INSTRUCTION 1: You MUST synthesize the knowledge from ALL the provided Context Blocks. At the end of your answer, you MUST list the exact [Source: ...] tags for EVERY Context Block you used in a neat list. DO NOT make up information.
CRITICAL INSTRUCTION 2: You MUST detect the language of the student's question and write your final response ENTIRELY in that exact same language (e.g. Hindi, English, etc).

### CONTEXT BLOCKS:
{context}

### STUDENT QUESTION:
{question}
"""

QUIZ_PROMPT = """You are an expert exam creator. The student has been asking about these topics: {topics}.
Generate a 5-question multiple choice quiz testing their knowledge on these specific topics.

CRITICAL INSTRUCTION: You MUST output ONLY valid JSON. No markdown, no backticks, no introduction. Just the JSON array.
Format MUST strictly be a JSON list of objects exactly like this string format:
[
  {"question": "What is...", "options": ["A. Full text", "B. Full text", "C. Full text", "D. Full text"], "answer": "B"},
  {"question": "Why does...", "options": ["A. Explanation", "B. Explanation", "C. Explanation", "D. Explanation"], "answer": "A"}
]
!!! Make sure the text inside 'options' contains the actual descriptive choices, NOT just the letter!
"""

PERFECT_SCORE_PROMPT = """You are an expert educational psychologist. A student scored {score}/{total} — a PERFECT SCORE.

Questions they answered perfectly:
{breakdown}

Write ONE short paragraph (3-4 sentences) for the student's report card that:
1. Praises their specific conceptual strengths demonstrated by these questions.
2. Suggests one specific concept in this topic area they should explore next to grow further.

Be specific to the actual quiz topics. Do NOT write generic praise. Write directly to the student (use "you")."""

EVALUATION_PROMPT = """You are an expert educational psychologist. A student scored {score}/{total}.

Their detailed quiz performance:
{breakdown}

Write ONE short paragraph (3-4 sentences) for the student's report card that:
1. Acknowledges what they understood correctly (from the CORRECT answers) — be specific to the topic.
2. Clearly explains what concepts they are confused about (from the WRONG answers) — name the exact concept.
3. Gives one concrete suggestion on how to improve.

Be specific to the actual quiz topics. Do NOT write "General Comprehension". Write directly to the student (use "you")."""

REPORT_PROMPT = """You are an expert Educational Psychologist. Below are several individual quiz evaluations for a student from their current study session.

{evaluations}

Synthesize all of these evaluations into ONE highly professional, 4-5 sentence Comprehensive Session Report Card paragraph.
1. Highlight their overarching strengths across these quizzes.
2. Identify any recurring vulnerabilities, confusions, or blind spots.
3. Provide a master recommendation for their next strategic learning steps.

Write directly to the student (use "you"). Be specific to the actual topics discussed. Do not output anything except the final synthesized paragraph."""
