"""quizloom: question-bank analytics as Spark DataFrame transformations."""
