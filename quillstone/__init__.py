"""quillstone: question-bank curation, tag verification, retrieval and learner analytics on Spark."""
