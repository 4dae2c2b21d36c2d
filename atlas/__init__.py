"""Page dumps, knowledge-base dumps and page-view logs as Spark tables, and questions about them."""
