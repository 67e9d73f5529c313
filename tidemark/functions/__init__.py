"""functions of the event-to-mart engine."""
