"""curatrix: labelled-text curation and classifier evaluation as Spark jobs."""
