"""Schemas of the files."""

PROGRAMS = "question_id string, question_text string, decomposition string, operators string, split string"
PARSER_INPUT = "question_id string, source string"
PERTURBED = "id string, question string, decomposition string, transformation string, type string"
ANSWER = "struct<number:string, date:struct<day:string, month:string, year:string>, spans:array<string>>"
DROP = f"map<string, struct<passage:string, wiki_url:string, qa_pairs:array<struct<question:string, query_id:string, answer:{ANSWER}, validated_answers:array<{ANSWER}>>>>>"
SQUAD_ANSWER = "struct<text:string, answer_start:int>"
SQUAD = (
    "version string, data array<struct<title:string, paragraphs:array<struct<context:string, qas:array<struct<id:string, question:string, is_impossible:boolean, "
    f"is_distant:boolean, is_boolq:boolean, answers:array<{SQUAD_ANSWER}>, plausible_answers:array<{SQUAD_ANSWER}>>>>>>>"
)
IIRC = (
    "pid string, text string, questions array<struct<qid:string, question:string, context:array<struct<passage:string, text:string, indices:array<int>>>, "
    "answer:struct<type:string, answer_value:string, answer_spans:array<struct<text:string>>>>>"
)
BOOLQ = "question string, answer boolean, passage string, title string"
HOTPOT = "_id string, answer string"
CWQ = "ID string, answers array<struct<answer:string>>"
PREDICTION = "qid string, query_id string, f1 double, em double, answer struct<value:string>"
STEP_ANSWERS = "qid string, orig_qid string, passage string, question string, transformed_decomposition array<string>, transformed_evaluated array<string>, step_answers array<string>"
QUESTIONS = "qid string, questions array<array<string>>, decomposition string, gold_question string"
PARSED = "qid string, question string, decomposition array<string>"
