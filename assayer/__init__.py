"""assayer: talent analytics and corpus preparation as plain DataFrame -> DataFrame functions."""
