"""Synthetic documents and tasks, keyed by number so that they are the same on any cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keyed_random as R

# The ten questions of each task type.
CODE_QUERIES = [
    "How to implement a binary search tree?",
    "What is the difference between list and tuple in Python?",
    "How to handle exceptions in Java?",
    "Explain the observer pattern with example",
    "How to optimize database queries?",
    "What is async/await in JavaScript?",
    "How to implement a REST API?",
    "Explain dependency injection",
    "How to use decorators in Python?",
    "What is the difference between stack and queue?",
]
SQL_QUERIES = [
    "How to join multiple tables in SQL?",
    "What is the difference between INNER JOIN and LEFT JOIN?",
    "How to optimize a slow SQL query?",
    "Explain window functions in SQL",
    "How to handle NULL values in SQL?",
    "What is a subquery and when to use it?",
    "How to create an index for better performance?",
    "Explain ACID properties in databases",
    "How to write a recursive CTE?",
    "What is the difference between DELETE and TRUNCATE?",
]
DIALOG_QUERIES = [
    "What is machine learning?",
    "Explain neural networks",
    "How does gradient descent work?",
    "What is overfitting and how to prevent it?",
    "Explain the difference between supervised and unsupervised learning",
    "How to evaluate a machine learning model?",
    "What is cross-validation?",
    "Explain regularization techniques",
    "How to handle imbalanced datasets?",
    "What is feature engineering?",
]
QUERIES = {"code": CODE_QUERIES, "sql": SQL_QUERIES, "dialog": DIALOG_QUERIES}


# The thirty topics of synthetic documents.
CODE_TOPICS = [
    "Binary search tree implementation with detailed examples",
    "Python list vs tuple: mutability, performance, use cases",
    "Exception handling in Java: try-catch, finally, custom exceptions",
    "Observer pattern: definition, UML diagram, code examples",
    "Database query optimization: indexing, query plans, caching",
    "JavaScript async/await: promises, error handling, best practices",
    "REST API design: endpoints, HTTP methods, status codes",
    "Dependency injection: IoC containers, benefits, examples",
    "Python decorators: syntax, use cases, advanced patterns",
    "Stack vs Queue: data structures, operations, applications",
]
SQL_TOPICS = [
    "SQL JOIN operations: INNER, LEFT, RIGHT, FULL OUTER JOIN",
    "SQL query optimization: indexes, execution plans, statistics",
    "Window functions: ROW_NUMBER, RANK, DENSE_RANK, aggregate functions",
    "NULL handling: IS NULL, COALESCE, NULLIF, three-valued logic",
    "Subqueries: correlated, uncorrelated, EXISTS, IN, scalar subqueries",
    "Database indexing: B-tree, hash indexes, composite indexes",
    "ACID properties: atomicity, consistency, isolation, durability",
    "Recursive CTEs: hierarchical queries, graph traversal",
    "SQL DELETE vs TRUNCATE: differences, use cases, performance",
    "SQL best practices: normalization, denormalization, query patterns",
]
LEARNING_TOPICS = [
    "Machine learning introduction: supervised, unsupervised, reinforcement",
    "Neural networks: perceptrons, backpropagation, activation functions",
    "Gradient descent: batch, stochastic, mini-batch, learning rate",
    "Overfitting: causes, detection, prevention techniques",
    "Model evaluation: accuracy, precision, recall, F1, ROC curve",
    "Cross-validation: k-fold, stratified, leave-one-out",
    "Regularization: L1, L2, dropout, early stopping",
    "Imbalanced datasets: SMOTE, undersampling, class weights",
    "Feature engineering: scaling, encoding, selection, extraction",
    "Deep learning: CNNs, RNNs, transformers, attention mechanisms",
]
TOPICS = [*CODE_TOPICS, *SQL_TOPICS, *LEARNING_TOPICS]


def tasks(spark: SparkSession, kind: str, n: int = 100, seed: int = 0, queries: list[str] | None = None) -> DataFrame:
    """``n`` tasks (task_id, query, task_type), each with a question drawn with replacement."""
    options = queries or QUERIES[kind]
    return spark.range(n).select(
        F.concat(F.lit(kind + "_"), F.col("id")).alias("task_id"),
        R.choice(options, seed, kind, F.col("id")).alias("query"),
        F.lit(kind).alias("task_type"),
    )


def all_tasks(spark: SparkSession, n: int = 100, seed: int = 0) -> DataFrame:
    """Tasks of every type, one after the other."""
    first, *rest = [tasks(spark, kind, n, seed) for kind in QUERIES]
    for more in rest:
        first = first.unionByName(more)
    return first


def documents(
    spark: SparkSession, n: int = 1000, low: int = 100, high: int = 2000, seed: int = 0, topics: list[str] | None = None
) -> DataFrame:
    """``n`` documents (doc_id, text) of ``low`` up to, but without, ``high`` characters.

    A document is one topic, ten blanks, and words of it, drawn with replacement and each after a blank, until it is
    long enough, and is cut.
    """
    topics = topics or TOPICS
    table = F.array(*[F.split(F.lit(t), " ") for t in topics])
    doc = spark.range(n).withColumnRenamed("id", "doc_id")
    doc = doc.select(
        "doc_id",
        F.element_at(table, 1 + R.integer(0, len(topics), seed, "topic", F.col("doc_id"))).alias("topic"),
        R.integer(low, high, seed, "length", F.col("doc_id")).alias("size"),
    )
    # a word and a blank take two characters at least, so size / 2 words are enough
    drawn = F.transform(
        F.sequence(F.lit(1), F.ceil(F.col("size") / 2).cast("int")),
        lambda i: F.element_at(
            F.col("topic"),
            (1 + F.floor(R.uniform(seed, "word", F.col("doc_id"), i) * F.size("topic"))).cast("int"),
        ),
    )
    text = F.concat(F.array_join("topic", " "), F.lit(" " * 11), F.array_join(drawn, " "))
    return doc.select("doc_id", F.substring(text, F.lit(1), F.col("size")).alias("text"))
