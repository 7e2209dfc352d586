"""Formats, labels, patterns and limits that results depend on. Plain text, in natural order."""

# --- fixed values -----------------------------------------------------------

#: Labels of a learner's state.
EMOTIONS = ["Engaged", "Curious", "Neutral", "Confusion", "Frustrated", "Bored", "Anxious", "Eureka", "Proud", "Relieved"]
EMOTION_GROUPS = {
    "positive": ["Engaged", "Curious", "Eureka", "Proud", "Relieved"],
    "neutral": ["Neutral"],
    "negative": ["Confusion", "Frustrated", "Bored", "Anxious"],
}
NO_EMOTION = "Unknown"

#: Marks of a drawing inside a problem; case counts.
DRAWING_MARKS = ["[asy]", "[/asy]"]
#: References to a figure; case does not count, and a dot matches line ends too.
FIGURE_PATTERNS_EN = ["shown.*figure", "shown.*diagram", "shown.*graph", "shown.*below", "as.*shown", "refer.*diagram"]
FIGURE_PATTERNS_JA = ["図.*示", "図.*よう", "下.*図", "図.*参照", "グラフ.*示", "図.*領域", "画.*領域"]
#: Columns that the bilingual filter joins, in this order.
PROBLEM_COLUMNS = ["original_problem", "translated_question", "problem", "question"]

#: Tags of a translator's reply.
TAG_THOUGHT, TAG_QUESTION, TAG_ANSWER = "[Thought Process]", "[Q]", "[A]"

#: The forms in which a problem is shown to a translator and to a maker of similar problems.
TRANSLATE_FORM = "[Original Q]\n{problem}\n\n[Original A]\n{solution}"
SIMILAR_FORM = "[Original Question]\n{question}\n\n[Original Solution]\n{solution}"

#: Labels of a learner's profile, with the field each one shows.
PROFILE_LABELS = [("学年", "grade"), ("学習済みの範囲", "learned_scope"), ("ミスしやすい点", "error_tendency"), ("苦手な範囲", "weak_area")]
EVALUATION_PROFILE_LABELS = [("学年", "grade"), ("学習済みの範囲", "learned_scope"), ("苦手な範囲", "weak_area")]
NO_FIELD = "不明"
#: Slots of prompt templates.
SLOT_PROBLEM, SLOT_PROFILE, SLOT_CONDITION, SLOT_MODE = "{TARGET_PROBLEM}", "{STUDENT_PROFILE}", "{INITIAL_CONDITION}", "{CURRENT_MODE}"
MODE_LEARNING, MODE_TRANSFER = "対話学習（Phase 1）", "類似問題テスト（Phase 2）"

#: The header above the problem in a fine-tuning record's system message.
SFT_PROBLEM_HEADER = "現在出題中の問題:"
#: The reasoning block before a tutor's words: begin, four labels with their fields, end.
REASONING_BEGIN, REASONING_END = "<analysis>", "</analysis>"
REASONING_LABELS = [("【推論プロセス】", "thought_process"), ("【生徒の感情】", "student_emotion"), ("&lt;ロードマップ&gt;", "roadmap_breakdown"), ("【次の一歩の計画】", "next_step_plan")]
#: Roles of dialogues and of chat records.
CHAT_ROLES = {"student": "user", "teacher": "assistant"}

#: Limits and seeds.
TRAIN_LIMIT, TEST_LIMIT, TEST_START, DIALOGUE_LIMIT, MAX_TURNS = 200, 40, 200, 200, 15
SPLIT_SEED, TRAIN_SHARE = 42, 0.8
TRAIN_ID, TEST_ID, NO_ID = "math_train_", "math_test_", "unknown_"
#: What stands for the answer of a call that failed.
FAILED_ANSWER, FAILED_JUDGE = "Error during generation", "API Error: "

#: Categories of the rubric.
RUBRIC = {"emotion_alignment": ["Good", "Bad"], "pedagogical_empathy": ["Excellent", "Acceptable", "Reject"], "length_control": ["Pass", "Fail"]}

# --- end of fixed values ----------------------------------------------------
