"""botlantern: bot and AI-usage analytics on Spark."""
